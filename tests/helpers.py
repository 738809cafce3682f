from corpuslint.config import Settings
from corpuslint.plans.analyze import analyze

UNCAPPED = Settings(max_files=None, max_total_bytes=None)


def rule_ids(tables):
    return {r.rule_id for r in tables.raw_issues().select("rule_id").collect()}


def issues_of(tables, rule_id):
    return [r.asDict() for r in tables.raw_issues([rule_id]).collect()]


def run(files, cfg=UNCAPPED, history=None):
    return analyze(files, history, cfg)

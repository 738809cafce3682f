"""Run settings and the fixed values the results depend on.

Everything a rule or sink reads is a plain literal here, so Catalyst sees
constants (and folds whole union branches away under a severity filter).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --------------------------------------------------------------------------
# Fixed values (must stay byte-exact: fingerprints, sinks and oracles use them)
# --------------------------------------------------------------------------

LANGUAGE_BY_SUFFIX = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java"}

DEFAULT_INCLUDE_GLOBS = ("**/*.py", "**/*.js", "**/*.ts", "**/*.java")
DEFAULT_EXCLUDE_GLOBS = (".git/**", "node_modules/**", "__pycache__/**", ".venv/**", "venv/**", "dist/**", "build/**")

ENTRYPOINT_NAMES = ("main.py", "app.py", "manage.py", "index.ts", "index.js")
CONFIG_NAMES = ("pyproject.toml", "package.json", "tsconfig.json", "requirements.txt")

SECRET_KEYWORDS = "(password|secret|token|api_key)"
SQL_KEYWORDS = ("SELECT ", "INSERT ", "UPDATE ", "DELETE ")
SNAKE_CASE = r"^[a-z_][a-z0-9_]*$"
PASCAL_CASE = r"^[A-Z][A-Za-z0-9]+$"

SHELL_CALLS = ("os.system", "subprocess.run", "subprocess.Popen")
DYNAMIC_EXEC_CALLS = ("eval", "exec")
PICKLE_CALLS = ("pickle.load", "pickle.loads")
YAML_LOAD_CALL = "yaml.load"
SAFE_YAML_LOADERS = ("yaml.SafeLoader", "SafeLoader")
MKTEMP_CALL = "tempfile.mktemp"
WEAK_RANDOM_CALLS = ("random.random", "random.randint", "random.choice", "random.randrange")
LOOP_IO_CALLS = ("open", "requests.get", "requests.post")

SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
SARIF_HELP_URI_PREFIX = "https://example.com/rules/"

BUDGET_REASON = "estimated_tokens_exceeded_budget"
SKIP_REASON = "filtered_or_budget_exceeded"
TEST_RESULT_PREFIX = "test-result:"
CROSS_FILE_HEURISTIC = "heuristic=cross-file-name-reference"
TEST_SCAN_HEURISTIC = "heuristic=test-file-name-scan"

# Full-mode families in task order; summary mode runs three of them.
FULL_FAMILIES = ("structure", "security", "style", "performance", "test")
SUMMARY_FAMILIES = ("structure", "security", "test")
# Ready tasks run sorted by task id, so issues concatenate in this order.
FAMILY_RANK = {"structure": 0, "performance": 1, "security": 2, "style": 3, "test": 4}

# Rule catalogue: rule_id -> (title, description, severity, confidence).
RULES = {
    "structure.circular-dependency": ("Circular dependency detected", "Static import analysis found a dependency cycle across files.", "medium", 0.85),
    "structure.large-function": ("Function is too large", "Function length exceeds the current structure threshold.", "low", 0.95),
    "structure.complex-function": ("Function has high branch complexity", "Function contains many branch nodes and may be difficult to reason about.", "medium", 0.9),
    "structure.unused-import": ("Unused import detected", "Imported symbol does not appear to be referenced in the file.", "low", 0.75),
    "structure.unused-function": ("Function appears unused", "Function definition is not referenced in other parsed files and may be dead code.", "low", 0.55),
    "structure.unused-class": ("Class appears unused", "Class definition is not referenced in other parsed files and may be dead code.", "low", 0.55),
    "structure.large-review-scope": ("Review scope is large", "The repository slice contains more than 20 files and may need stronger summarization.", "low", 0.9),
    "security.shell-true": ("Shell execution detected", "Shell execution can lead to command injection when arguments are influenced by user input.", "high", 0.95),
    "security.dynamic-execution": ("Dynamic execution detected", "Dynamic execution primitives increase remote code execution risk.", "medium", 0.95),
    "security.insecure-deserialization": ("Insecure deserialization detected", "Pickle deserialization can execute arbitrary code when input is untrusted.", "high", 0.95),
    "security.unsafe-yaml-load": ("Unsafe yaml.load detected", "yaml.load without SafeLoader can deserialize unsafe objects.", "high", 0.9),
    "security.tempfile-mktemp": ("Insecure tempfile.mktemp usage", "tempfile.mktemp can introduce race conditions and insecure temp file creation.", "medium", 0.95),
    "security.weak-random": ("Weak random source detected", "The random module is unsuitable for security-sensitive token or secret generation.", "low", 0.7),
    "security.sql-string-concat": ("SQL string concatenation detected", "SQL query construction via string concatenation may lead to injection risks.", "high", 0.8),
    "security.hardcoded-secret": ("Hardcoded secret detected", "Potential credential or token is embedded in source code.", "high", 0.9),
    "style.function-name": ("Function name should use snake_case", "Python function names should follow snake_case for consistency.", "low", 0.95),
    "style.function-length": ("Function is longer than style threshold", "Function length exceeds the configured style threshold.", "low", 0.95),
    "style.too-many-parameters": ("Function has too many parameters", "Function signature exceeds the preferred parameter count.", "low", 0.95),
    "style.class-name": ("Class name should use PascalCase", "Python class names should follow PascalCase.", "low", 0.95),
    "performance.loop-io": ("I/O call inside loop", "Repeated I/O inside a loop may cause avoidable latency.", "medium", 0.85),
    "performance.repeated-len-call": ("Repeated len() call inside loop", "Repeated length calculation inside a loop may be cached for clarity and efficiency.", "low", 0.8),
    "performance.context-budget": ("Context budget exceeded", "Context estimation exceeded the configured budget and may degrade review quality.", "medium", 0.9),
    "test.no-tests-detected": ("No tests detected in review scope", "The current review scope does not include obvious test files.", "low", 0.7),
    "test.missing-targeted-test": ("No targeted test file mapped", "The changed source file has no obvious matching test file by naming convention.", "low", 0.7),
}

# Family roll-up severity when a family has at least one issue.
FAMILY_ISSUE_SEVERITY = {"structure": "low", "security": "high", "style": "low", "performance": "medium", "test": "low"}

# Error-message categories for source references, tested in this order.
CLONE_ERROR_CATEGORIES = (
    ("repository_not_found", ("repository not found", "not found")),
    ("permission_denied", ("permission denied", "access denied", "authentication failed")),
    ("network_error", ("could not resolve host", "failed to connect", "network is unreachable")),
    ("invalid_reference", ("remote branch", "reference is not a tree", "couldn't find remote ref")),
)
REMOTE_REF_PREFIXES = ("https://", "http://", "git@", "ssh://", "file://")
GITHUB_HTTP_PREFIXES = ("https://github.com/", "http://github.com/")


@dataclass(frozen=True)
class Settings:
    """Thresholds and switches of one analysis run (defaults mirror the reference, except that no cap is set)."""

    include_globs: tuple[str, ...] = DEFAULT_INCLUDE_GLOBS
    exclude_globs: tuple[str, ...] = DEFAULT_EXCLUDE_GLOBS
    history_file_path: str = ".code-review-history.json"
    # Caps are options: by default no file is dropped and no history row is forgotten.
    max_files: int | None = None
    max_file_bytes: int | None = None
    max_total_bytes: int | None = None
    structure_summary_max_paths: int = 20
    dependency_edge_cap: int = 100
    key_files_cap: int = 10
    history_max_entries: int | None = None
    tokenizer_name: str = "simple-char-budget"
    structure_summary_cap: int = 4000
    key_files_token_cap: int = 4000
    dependency_token_cap: int = 4000
    per_file_issue_budget: int = 1000
    structure_max_function_lines: int = 40
    structure_max_branch_nodes: int = 8
    style_max_function_lines: int = 30
    style_max_parameters: int = 5
    large_scope_files: int = 20
    breaker_failure_threshold: int = 3
    breaker_reset_seconds: int = 30
    review_changed_files_only: bool = True
    report_only_new_issues: bool = True
    self_verification_enabled: bool = True
    summary_only: bool = False
    # "union" keeps old fingerprints of still-present files (stable suppression);
    # "replace" overwrites them with the new issues' fingerprints (reference behaviour).
    history_mode: str = "union"
    families: tuple[str, ...] | None = None
    # Spread the parse over this many tasks first (for few, large input partitions).
    parse_partitions: int | None = None

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)

    @property
    def active_families(self) -> tuple[str, ...]:
        if self.families is not None:
            return self.families
        return SUMMARY_FAMILIES if self.summary_only else FULL_FAMILIES

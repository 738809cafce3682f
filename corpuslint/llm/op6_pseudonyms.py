"""Personal data: format-preserving Feistel pseudonyms (DataFrame functions only).

Found values are replaced by values of the same format under a key: every digit
stays a digit, every letter a letter of the same case, separators stay. A value's
characters are cut into halves; in each of eight rounds one half is shifted,
character by character inside its class, by a keyed hash of the other half. That
is a permutation of all values of the format, so equal values get equal pseudonyms
in all documents, different values different ones, and the key's owner can undo it.

* payment cards (13 to 19 digits with a right check digit): the digits but the first
  and the check digit, which is computed anew. In a run of digit groups every stretch
  of whole groups is tested, the longest first; dates and numbers beside a card in its
  run are replaced as elsewhere
* IPv4 addresses: the 32-bit number, as two halves of 16 bits
* dates (yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy, existing ones): the day's number in its
  window of 191 * 191 days from 1950-01-01
* phone numbers (country code kept), social security numbers: their digits
* e-mail addresses: the part before the @; access keys and `password=`, `token=`
  and the like: the value

Numbers of these shapes that are not valid (check digit, octet, calendar) stay.

Defined cases: a null text stays null, an empty one empty; repeated rows give a row
each; an empty table gives no rows; all other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEFAULT_KEY = "change me: the key is a parameter"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ASSIGNED = r"(?i:\b(?:password|passwd|secret|token|api_?key|access_?key)) ?[=:] ?[\"']?"
PATTERNS = {
    "secret": rf"{ASSIGNED}[A-Za-z0-9+/_-]{{8,}}",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "world_phone": r"(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
#: What a run of digit groups does not reach into: values that go on with other characters.
_APART = "|".join([PATTERNS["email"], PATTERNS["ip"], r"(?<![0-9/-])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/-])",
                   r"(?<![0-9])(?:[0-9]{3}\.[0-9]{3}[ .-]|[0-9]{3}[ .-][0-9]{3}\.)[0-9]{4}(?![0-9])"])
PATTERNS["card"] = rf"(?<![0-9])[0-9](?:[ -]?+(?!{_APART})[0-9]){{12,}}+"  # a whole run of groups, of which some may be a card
#: The other values that can stand in such a run.
IN_RUN = "|".join(PATTERNS[kind] for kind in ("date", "ssn", "phone"))
ANY = "|".join(PATTERNS.values())
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WINDOW, _SIDE, _FIRST_DAY = 191 * 191, 191, -7305


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _chars(text: Column, body) -> Column:
    """The text with body(character, place from 1) for each character."""
    return F.when(F.length(text) > 0, F.array_join(F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: body(F.substr(text, i, F.lit(1)), i)), "")).otherwise("")


def _shift(c: Column, by: Column) -> Column:
    def inside(alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))

    return (F.when(F.instr(F.lit(_DIGITS), c) > 0, inside(_DIGITS)).when(F.instr(F.lit(_LOW), c) > 0, inside(_LOW))
            .when(F.instr(F.lit(_UP), c) > 0, inside(_UP)).otherwise(c))


def permuted(text: Column, tag: str, key: str) -> Column:
    """A keyed permutation of the texts with the same classes of characters in the same places."""
    def half(x: Column, other: Column, k: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(x) / 32).cast("int")),
                             lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), k.cast("string"), b.cast("string"), other), 256))
        return _let(F.array_join(blocks, ""), lambda d: _chars(x, lambda c, i: _shift(c, F.conv(F.substr(d, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("l"), F.substr(text, cut + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda a, k: F.when(
        k % 2 == 0, F.struct(half(a["l"], a["r"], k).alias("l"), a["r"].alias("r"))).otherwise(
        F.struct(a["l"].alias("l"), half(a["r"], a["l"], k).alias("r"))), lambda a: F.concat(a["l"], a["r"]))


def permuted_pair(l: Column, r: Column, m: int, n: int, tag: str, key: str) -> Column:
    """A keyed permutation of the pairs (l in 0..m-1, r in 0..n-1)."""
    def drawn(other: Column, k: Column, size: int) -> Column:
        return F.pmod(F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), k.cast("string"), other.cast("string")), 256), F.lit(1), F.lit(12)), 16, 10).cast("long"), F.lit(size))

    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda a, k: F.when(
        k % 2 == 0, F.struct(((a["l"] + drawn(a["r"], k, m)) % m).alias("l"), a["r"].alias("r"))).otherwise(
        F.struct(a["l"].alias("l"), ((a["r"] + drawn(a["l"], k, n)) % n).alias("r"))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order, by the given ones."""
    return _let(digits, lambda d: F.aggregate(
        F.sequence(F.lit(1), F.length(text)), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, i: _let(F.substr(text, i, F.lit(1)), lambda c: F.when(
            F.instr(F.lit(_DIGITS), c) > 0, F.struct(F.concat(a["out"], F.substr(d, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k")))
            .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))), lambda a: a["out"]))


def check_digit(payload: Column) -> Column:
    """The Luhn check digit of the digits before it."""
    n = F.length(payload)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + _let(
        F.substr(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        return _let(F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(F.substr(d, F.lit(2), n - 2), "card", key)), lambda p: F.concat(p, check_digit(p)))

    return _let(_digits(m), lambda d: _refilled(m, new(d)))


def _cards_in(groups: Column) -> Column:
    """(i, n) of the stretches of n groups from the i-th (from 0) on that are cards, apart from each other, in order: the longest are taken first."""
    def stretches(i: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)),
                           lambda n: F.struct(i.alias("i"), n.alias("n"), _digits(F.array_join(F.slice(groups, i + 1, n), "")).alias("d")))
        return F.filter(each, lambda w: F.length(w["d"]).between(13, 19) & (
            check_digit(F.substr(w["d"], F.lit(1), F.length(w["d"]) - 1)) == F.substr(w["d"], F.length(w["d"]), F.lit(1))))

    valid = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), stretches))
    order = F.sort_array(F.transform(valid, lambda w: F.struct((-F.length(w["d"])).alias("longest"), w["i"].alias("i"), w["n"].alias("n"))))
    chosen = F.aggregate(order, F.filter(order, lambda w: F.lit(False)), lambda a, w: F.when(
        F.exists(a, lambda c: (c["i"] < w["i"] + w["n"]) & (w["i"] < c["i"] + c["n"])), a).otherwise(F.concat(a, F.array(w))))
    return F.sort_array(F.transform(chosen, lambda w: F.struct(w["i"].alias("i"), w["n"].alias("n"))))


def _between(x: Column, key: str) -> Column:
    """(text, number of values) of digit groups that are no card."""
    def one(m: Column) -> Column:
        whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
        return (F.when(whole("date"), _date(m, key)).when(whole("ssn"), _refilled(m, permuted(_digits(m), "ssn", key)))
                .otherwise(_refilled(m, permuted(_digits(m), "phone", key))))

    found, parts = F.regexp_extract_all(x, F.lit(IN_RUN), F.lit(0)), F.split(x, IN_RUN)
    new = F.concat(F.get(parts, 0), F.array_join(F.zip_with(found, F.slice(parts, 2, F.size(found)), lambda m, p: F.concat(one(m), p)), ""))
    return F.struct(F.when(F.size(found) > 0, new).otherwise(x).alias("text"), F.size(found).alias("n"))


def _run(m: Column, key: str) -> Column:
    """(text, number of places) of a run of digit groups."""
    def pieces(groups: Column, cards: Column) -> Column:
        joined = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")
        end = lambda k: F.when(k < 0, 0).otherwise(F.get(cards, k)["i"] + F.get(cards, k)["n"])
        # the k-th stretch between cards, then the k-th card; a card's last separator stands apart
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cards)), lambda k: _let(
            F.when(k == 0, "").otherwise(F.regexp_extract(F.get(groups, end(k - 1) - 1), "[ -]$", 0)),
            lambda sep: _let(F.coalesce(F.get(cards, k)["i"], F.size(groups)), lambda upto: F.concat(
                F.array(_between(F.concat(sep, joined(end(k - 1), upto - end(k - 1))), key)),
                F.when(k < F.size(cards), F.array(F.struct(
                    _card(F.regexp_replace(joined(upto, F.get(cards, k)["n"]), "[ -]$", ""), key).alias("text"), F.lit(1).alias("n"))))
                .otherwise(F.array().cast("array<struct<text:string,n:int>>")))))))

    def summed(p: Column) -> Column:
        n = F.aggregate(p, F.lit(0), lambda a, x: a + x["n"])
        shaped = F.length(_digits(m)) <= 19  # an invalid number of a card's shape is a place, too
        return F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"), F.when((n == 0) & shaped, 1).otherwise(n).alias("n"))

    return _let(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), lambda g: _let(_cards_in(g), lambda c: _let(pieces(g, c), summed)))


def _ip(m: Column, key: str) -> Column:
    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), lambda o: _let(
        permuted_pair(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), 65536, 65536, "ip", key),
        lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])))


def _date(m: Column, key: str) -> Column:
    def moved(day: Column, form: str) -> Column:
        def new(z: Column) -> Column:
            k = F.floor(z / _WINDOW)
            o = z - k * _WINDOW
            return _let(permuted_pair(F.floor(o / _SIDE), o % _SIDE, _SIDE, _SIDE, "date", key),
                        lambda p: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (k * _WINDOW + p["l"] * _SIDE + p["r"] + _FIRST_DAY).cast("int")), form))

        return _let(F.datediff(day, F.lit("1970-01-01").cast("date")) - _FIRST_DAY, new)

    def tried(form: str, after: Column) -> Column:
        return _let(F.try_to_timestamp(m, F.lit(form)).cast("date"), lambda d: F.when(d.isNotNull(), moved(d, form)).otherwise(after))

    return F.when(F.substr(m, F.lit(5), F.lit(1)) == "-", tried("yyyy-MM-dd", m)).otherwise(tried("dd/MM/yyyy", tried("MM/dd/yyyy", m)))


def replacement(m: Column, key: str) -> Column:
    """(text, number of places): the pseudonym of one found value (the first pattern that it fits whole)."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    before = F.regexp_extract(m, f"^{ASSIGNED}", 0)
    rest = F.substr(m, F.length(before) + 1, F.length(m))
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    number = F.substr(m, F.length(country) + 1, F.length(m))
    at = F.instr(m, F.lit("@"))
    one = (F.when(whole("secret"), F.concat(before, permuted(rest, "secret", key)))
            .when(whole("access_key"), F.concat(F.lit("AKIA"), permuted(F.substr(m, F.lit(5), F.lit(16)), "access", key)))
            .when(whole("email"), F.concat(permuted(F.substr(m, F.lit(1), at - 1), "email", key), F.substr(m, at, F.length(m))))
            .when(whole("ip"), _ip(m, key)).when(whole("date"), _date(m, key))
            .when(whole("ssn"), _refilled(m, permuted(_digits(m), "ssn", key)))
            .when(whole("phone") | whole("world_phone"), F.concat(country, _refilled(number, permuted(_digits(number), "phone", key))))
            .otherwise(m))
    return F.when(whole("card"), _run(m, key)).otherwise(F.struct(one.alias("text"), F.lit(1).alias("n")))


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """The input's rows with personal data in `text` replaced; `count` names a further column with the number of places found."""
    names, kinds = docs.columns, dict(docs.dtypes)
    d = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text").alias("t"))
    d = d.select("row", F.when(F.col("t").rlike("[0-9@=:]|AKIA"), F.regexp_extract_all("t", F.lit(ANY), F.lit(0))).alias("found"), "t")
    some = F.size("found") > 0
    d = d.withColumn("parts", F.when(some, F.split("t", ANY))).withColumn("values", F.when(some, F.transform("found", lambda m: replacement(m, key))))
    new = F.concat(F.get("parts", 0), F.array_join(F.zip_with("values", F.slice("parts", 2, F.size("found")), lambda m, p: F.concat(m["text"], p)), ""))
    d = d.withColumn("new", F.when(some, new).otherwise(F.col("t")))
    out = {"text": F.col("new")}
    if "n_chars" in names:
        out["n_chars"] = F.when(some, F.length("new").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    cols = [out.get(n, F.col("row")[n]).alias(n) for n in names]
    return d.select(*cols, *([F.when(some, F.aggregate("values", F.lit(0), lambda a, v: a + v["n"])).otherwise(0).alias(count)] if count else []))


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), count="n_found")

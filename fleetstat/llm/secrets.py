"""Secret scan: fixed patterns plus sliding-window entropy, in SQL functions only.

Spans are code point ranges, end exclusive. Three pattern kinds are always
reported; the method adds spans of kind ``entropy``:

* a candidate is a maximal run of 20 or more characters of ``[A-Za-z0-9+/=_-]``;
* its class is ``hex`` if it consists of hexadecimal digits alone, else ``base64``;
* a window of WINDOW characters slides over it. Counts per character are kept
  in an array, and the sum of c * log2(c) changes by the one character that
  enters and the one that leaves, so each step costs the same;
* if the largest entropy of a window reaches the threshold of the class, and the
  candidate holds letters and digits, it is a secret, unless the allow-list
  matches it. Pattern spans are never suppressed.

Every row gives one row. A null text counts as empty. Columns other than the
identifier and the text are neither read nor returned by `scan`; `redact` keeps
the columns it is given. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import text_of

# The patterns and least lengths of the scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
# A run is matched whole or not at all, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
THRESHOLD = {"hex": 3.0, "base64": 3.9}
#: Placeholders that documentation uses in place of secrets.
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[_-]|0123456789|abcdefgh|([0-9a-z])\1{7}"


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("long").alias("end"))


_NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All matches as spans: the pieces between matches and the matches alternate, so running lengths give the places."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if keep else 0)).alias("value"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_NO_SPANS).alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["between"])
        end = begin + F.coalesce(F.length(p["match"]), F.lit(0))
        found = p["match"].isNotNull() & (keep(p["value"]) if keep else F.lit(True))
        return F.struct(
            end.cast("long").alias("at"),
            F.when(found, F.array_append(acc["spans"], _span(kind, begin, end))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of a candidate."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weight = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    start = F.struct(F.lit(1).alias("i"), zero.alias("counts"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("best"))

    def of(codes):
        def step(acc, code):
            gone = F.when(acc["i"] > window, F.get(codes, acc["i"] - window - 1)).otherwise(F.lit(-1))
            counts = F.transform(acc["counts"], lambda n, k: n + (k == code).cast("int") - (k == gone).cast("int"))
            entered, left = F.get(acc["counts"], code), F.get(acc["counts"], gone)
            same = code == gone
            mass = F.when(same, acc["mass"]).otherwise(
                acc["mass"] + weight(entered + 1) - weight(entered)
                + F.when(gone < 0, F.lit(0.0)).otherwise(weight(left - 1) - weight(left)))
            full = F.log2(F.lit(float(window))) - mass / window
            return F.struct(
                (acc["i"] + 1).alias("i"), counts.alias("counts"), mass.alias("mass"),
                F.when(acc["i"] >= window, F.greatest(acc["best"], full)).otherwise(acc["best"]).alias("best"))
        return F.aggregate(codes, start, step, lambda acc: acc["best"])

    # The codes are bound once, as the only element of an array, instead of once for each step.
    return F.element_at(F.transform(F.array(codes), of), 1)


def _entropy_spans(text: Column, allowed: str, thresholds: dict[str, float]) -> Column:
    candidates = F.filter(
        F.arrays_zip(_spans(text, CANDIDATE, "entropy").alias("span"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("value")),
        lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~c["value"].rlike(allowed))
    least = lambda v: F.when(v.rlike("^[0-9a-fA-F]+$"), F.lit(thresholds["hex"])).otherwise(F.lit(thresholds["base64"]))
    return F.transform(F.filter(candidates, lambda c: window_entropy(c["value"]) >= least(c["value"])), lambda c: c["span"])


def find(df: DataFrame, text_col: str = "text", allowed: str = ALLOWED, thresholds: dict[str, float] = THRESHOLD, into: str = "spans") -> DataFrame:
    """Add the column `into`: all spans of the text, ordered by start, then kind.

    Cheap tests come first: only a text with one of the words is matched against
    the assignment pattern, and only one with a long run against the others.
    """
    text, none = text_of(text_col), F.array().cast(_NO_SPANS)
    lower = F.lower(text)
    words = F.lit(False)
    for w in ASSIGN_WORDS:
        words = words | F.contains(lower, F.lit(w))
    runs = text.rlike(CANDIDATE)
    base = F.concat(
        F.when(words, _spans(text, ASSIGN, "assign", lambda v: F.length(v) >= ASSIGN_LEAST)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")).otherwise(none),
        F.when(runs, _spans(text, HEX, "hex")).otherwise(none))
    added = F.when(runs, _entropy_spans(text, allowed, thresholds)).otherwise(none)
    return df.withColumn(into, F.array_sort(F.concat(base, added)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row: the identifier and its spans."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return find(rows, "text", **options).select("doc_id", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of scanned rows."""
    entropy = KINDS.index("entropy")
    base = F.filter("spans", lambda s: s["kind"] < entropy)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("entropy"))


def redact(df: DataFrame, text_col: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """Replace each run of overlapping spans by the mask; a null text stays null, all columns and rows stay."""
    taken = {c.lower() for c in df.columns}
    into = next(name for i in range(len(taken) + 1) if (name := f"spans_{i}") not in taken)
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        piece = F.when(
            s["start"] >= acc["at"],
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        ).otherwise(acc["out"])
        return F.struct(piece.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(F.col(into), start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.length(text) - acc["at"], F.lit(0)).cast("int"))))
    clean = F.when(F.size(into) > 0, masked).otherwise(text)
    return find(df, text_col, into=into, **options).withColumn(text_col, clean).drop(into)

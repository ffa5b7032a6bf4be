"""Secret scans by patterns and a battery of randomness tests, with DataFrame functions only.

Beside the three fixed patterns, runs of encoded-looking characters are tested for what
a random key must look like in its inferred encoding: uniform use of the alphabet
(chi-squared), as many runs above and below the alphabet's middle as chance gives, and no
correlation between neighbours.  The tests' p-values are combined.  Random keys have
p-values that are uniform, and other text has ones near 0, so the p-values well above 0
tell how many keys there are in a stratum of encoding and length; what is reported below
them is cut where the share of false ones among all reported would pass the level.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import table

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_CODED = r"[A-Za-z0-9+/_-]{24,}={0,2}"

#: Encodings in the order of inference: name, form, alphabet in its order.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

#: Combined p-values are counted in so many steps of a power of ten, down to 1e-16.
_STEPS, _FLOOR = 20, 1e-16

_SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


def _located(matches: Column, pieces: Column, kind: int, keep) -> Column:
    """Places of the matches, from the pieces of text between them; keep: which (match, its place) count."""
    at = F.aggregate(
        F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m["whole"]).alias("n"), m["value"].alias("value"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(keep(x["value"]), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), F.lit(kind).alias("kind"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(matches) > 0, at).otherwise(F.array().cast(_SPAN))


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, by a rational approximation."""

    def tail(v: Column) -> Column:
        t = v["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.greatest(F.exp(-v["z"] * v["z"] / 2) / math.sqrt(2 * math.pi) * poly, F.lit(_FLOOR))

    return _let(z, lambda v: _let(F.struct(v.alias("z"), (1 / (1 + 0.2316419 * v)).alias("t")), tail))


def _two_sided(z: Column) -> Column:
    return F.least(2 * _normal_tail(F.abs(z)), F.lit(1.0))


def battery(s: Column) -> Column:
    """Struct of encoding (null: none), n, and the p-value that s is random in it, with those of the three tests."""
    code = F.lit(None).cast("string")
    for name, form, _ in reversed(ENCODINGS):
        code = F.when(s.rlike(form), name).otherwise(code)
    alphabet = F.create_map(*(F.lit(v) for name, _, letters in ENCODINGS for v in (name, letters)))
    body = F.rtrim(s, F.lit("="))

    def places(b: Column) -> Column:
        # x: place of each character in its alphabet.
        x = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(b["letters"], c).cast("double") - 1)
        return F.struct(b["code"].alias("encoding"), F.length(b["letters"]).cast("double").alias("k"), x.alias("x"), F.length(body).cast("double").alias("n"))

    return _let(code, lambda c: _let(F.struct(c.alias("code"), F.element_at(alphabet, c).alias("letters")), lambda b: _let(places(b), _tested)))


def _tested(b: Column) -> Column:
    k, x, n = b["k"], b["x"], b["n"]
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
    first = F.struct(
        F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))).alias("pairs"),
        F.transform(x, lambda v: F.when(v * 2 >= k, 1.0).otherwise(0.0)).alias("high"),
        (total(x) / n).alias("mean"),
    )

    def second(f: Column) -> Column:
        return F.struct(
            (k / n * f["pairs"] - n).alias("chi"),
            total(f["high"]).alias("n1"),
            (1 + total(F.zip_with(F.slice(f["high"], F.lit(1), F.size(x) - 1), F.slice(f["high"], F.lit(2), F.size(x)), lambda u, v: F.abs(u - v)))).alias("runs"),
            F.transform(x, lambda v: v - f["mean"]).alias("d"),
        )

    def third(g: Column) -> Column:
        d = g["d"]
        return F.struct(
            ((g["chi"] - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("z1"),
            g["runs"].alias("runs"),
            (2 * g["n1"] * (n - g["n1"])).alias("both"),
            F.greatest(total(F.transform(d, lambda v: v * v)), F.lit(1e-9)).alias("square"),
            total(F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d)), lambda u, v: u * v)).alias("lag"),
        )

    def tails(h: Column) -> Column:
        sd = F.sqrt(F.greatest(h["both"] * (h["both"] - n) / (n * n * (n - 1)), F.lit(1e-9)))
        high = _normal_tail(F.abs(h["z1"]))
        return F.struct(
            F.when(h["z1"] > 0, high).otherwise(1 - high).alias("p1"),
            _two_sided((h["runs"] - h["both"] / n - 1) / sd).alias("p2"),
            _two_sided((h["lag"] / h["square"] + 1 / n) * F.sqrt(n)).alias("p3"),
        )

    def combined(p: Column) -> Column:
        # Fisher's combination of three p-values: chi-squared with six degrees of freedom, whose tail is closed.
        tail = _let(-(F.log(p["p1"]) + F.log(p["p2"]) + F.log(p["p3"])), lambda h: F.greatest(F.exp(-h) * (1 + h + h * h / 2), F.lit(_FLOOR)))
        return F.struct(b["encoding"].alias("encoding"), n.cast("bigint").alias("n"), tail.alias("p"), p["p1"].alias("uniformity"), p["p2"].alias("runs"), p["p3"].alias("correlation"))

    return _let(first, lambda f: _let(second(f), lambda g: _let(third(g), lambda h: _let(tails(h), combined))))


def _stratum(t: Column) -> Column:
    return F.concat_ws("/", t["encoding"], F.floor(F.log2(t["n"].cast("double"))).cast("string"))


def _bin(t: Column) -> Column:
    return F.floor(-F.log10(t["p"]) * _STEPS).cast("int")


def _candidates(text: Column) -> Column:
    """Encoded-looking runs with a digit and a letter, in order; the places of the others are not needed."""
    return F.filter(F.regexp_extract_all(text, F.lit(_CODED), 0), _worth)


def _worth(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


#: p-values in bins below this one are taken to be those of keys; strata of fewer candidates go by their encoding.
_KEYS_BIN, _FEW = 14, 100


def cut(bins: list[tuple[int, int]], level: float, min_p: float) -> int:
    """The bin from which candidates aren't reported, for (bin, count) of a stratum's p-values.

    Among p-values above q, the part 1 - q of all keys lies; so n above q stand for n / (1 - q)
    keys.  Reporting all above t, the keys among them are expected to be that by 1 - t, and the
    others are false.  The least t >= min_p whose false share is at most the level, but for one
    standard error of the number of keys, is taken; at t = q it always is.
    """
    q = 10 ** (-_KEYS_BIN / _STEPS)
    above = lambda b: sum(n for x, n in bins if x < b)
    keys = above(_KEYS_BIN) / (1 - q)
    error = math.sqrt(keys * q / (1 - q))
    for b in range(int(-math.log10(min_p) * _STEPS + 1e-9), _KEYS_BIN, -1):
        n = above(b)
        if n - keys * (1 - 10 ** (-b / _STEPS)) <= level * n + error:
            return b
    return _KEYS_BIN


def thresholds(docs: DataFrame, text_col: str = "text", level: float = 0.05, min_p: float = 0.01) -> dict[str, int]:
    """For each stratum the bin of p-values from which its candidates aren't reported; see `cut`.

    Strata are encodings and doublings of length; those of few candidates go by all lengths of
    their encoding together.  Only counts by stratum and bin are collected, of which there is a
    fixed number; all candidates of the table are counted.
    """
    each = docs.select(F.explode(_candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("m")).select(battery(F.col("m")).alias("t")).where("t.encoding IS NOT NULL")
    counts = each.groupBy(_stratum(F.col("t")).alias("s"), _bin(F.col("t")).alias("b")).count().collect()
    by: dict[str, dict[int, int]] = {}
    for r in counts:
        for s in (r["s"], r["s"].split("/")[0]):
            own = by.setdefault(s, {})
            own[r["b"]] = own.get(r["b"], 0) + r["count"]
    enough = lambda s: s if sum(by[s].values()) >= _FEW else s.split("/")[0]
    return {s: cut(sorted(by[enough(s)].items()), level, min_p) for s in by if "/" in s}


def add_spans(docs: DataFrame, limits: dict[str, int], text_col: str = "text", min_p: float = 0.01) -> DataFrame:
    """docs with the columns __base__ and __spans__: (start, end, kind) by start, then kind.

    Columns of docs named like the working ones (__t__, __w0__, __m0__ to __m3__, __p0__ to __p3__) are lost.
    """
    t = F.coalesce(F.col("__t__"), F.lit(""))
    df = docs.withColumn("__t__", F.col(text_col))
    whole = lambda pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda m: F.struct(m.alias("whole"), m.alias("value")))
    df = df.withColumn("__w0__", F.regexp_extract_all(t, F.lit(_ASSIGN), 0))
    df = df.withColumn("__m0__", F.when(F.size("__w0__") > 0, F.zip_with("__w0__", F.regexp_extract_all(t, F.lit(_ASSIGN), 2), lambda w, v: F.struct(w.alias("whole"), v.alias("value")))).otherwise(F.array().cast("array<struct<whole:string,value:string>>")))
    for k, pattern in ((1, _ACCESS), (2, _HEX), (3, _CODED)):
        df = df.withColumn(f"__m{k}__", whole(pattern))
    for k, pattern in enumerate((_ASSIGN, _ACCESS, _HEX, _CODED)):
        df = df.withColumn(f"__p{k}__", F.when(F.size(f"__m{k}__") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    every = lambda v: F.lit(True)
    known = F.from_json(F.lit(json.dumps(limits)), "map<string,int>")

    def random(v: Column) -> Column:
        def passes(b: Column) -> Column:
            return b["encoding"].isNotNull() & (b["p"] >= min_p) & (_bin(b) < F.coalesce(F.element_at(known, _stratum(b)), F.lit(2**30)))

        return _worth(v) & F.exists(F.array(battery(v)), passes)

    base = F.concat(_located(F.col("__m0__"), F.col("__p0__"), 0, lambda v: F.length(v) >= 6), _located(F.col("__m1__"), F.col("__p1__"), 1, every), _located(F.col("__m2__"), F.col("__p2__"), 2, every))
    df = df.withColumn("__base__", F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    more = F.filter(_located(F.col("__m3__"), F.col("__p3__"), 3, random), lambda s: ~F.exists("__base__", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    df = df.withColumn("__spans__", F.when(F.size("__m3__") > 0, F.array_sort(F.concat("__base__", added))).otherwise(F.col("__base__")))
    return df.drop("__t__", "__w0__", *(f"__{c}{k}__" for c in "mp" for k in range(4)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = 0.05, min_p: float = 0.01) -> DataFrame:
    """Secrets in each row: id_col, spans (start, end, kind: a name of KINDS) by start, then kind.

    Places are code points, ends exclusive.  All spans of the patterns assign, access and
    hex are in; "random" spans are runs of encoded-looking characters of 24 and more with
    a digit and a letter, which overlap none of them and pass the battery: combined
    p-value min_p or more, and above the cut that keeps the false ones among a stratum's
    reported spans at `level` (see `cut`).

    Null and empty texts have none; repeated rows each get their own; null ids stay null;
    an empty table has no rows and no thresholds.  Other columns are ignored.
    """
    df = docs.select(F.col(id_col), F.col(text_col).alias("__text__"))
    found = add_spans(df, thresholds(docs, text_col, level, min_p), "__text__", min_p)
    name = F.array(*(F.lit(k) for k in KINDS))
    return found.select(id_col, F.transform("__spans__", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(name, s["kind"] + 1).alias("kind"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str, mark: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: every secret span is replaced by a mark; rows and columns stay, n_chars follows the text.

    Overlapping spans share a mark.  Null texts stay null, as does their n_chars; empty texts
    and texts without a secret stay as they are; repeated rows are treated alike; ids aren't
    looked at; columns of any name stay as they are.
    """
    names = docs.columns
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), F.col("text"))
    found = add_spans(row, thresholds(docs))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    part = lambda a, z: F.substring(text, (a + 1).cast("int"), (z - a).cast("int"))
    cut_ = F.aggregate(
        "__spans__",
        state,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], part(a["at"], s["start"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], part(a["at"], F.length(text).cast("bigint"))),
    )
    text_ = F.when(F.size("__spans__") > 0, cut_).otherwise(text)
    own = found.select("row", text_.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return own.select(*((new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in names))


def brute_force(text: str | None) -> list[tuple[int, str, int]]:
    """Spans of the fixed patterns as the contract writes them, for tests."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?ai:password|passwd|secret|token|api_?key))"), t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]

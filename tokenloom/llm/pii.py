"""Personal data by weak supervision.

Candidates come from strict patterns, looser ones, and gazetteers of top-level domains,
dial codes, card prefixes and address blocks.  Labelers of several kinds (pattern,
checksum, gazetteer, context, border) vote on every candidate span.
Expectation-maximisation over the counts of all vote patterns, of which there is a bounded
number, estimates how reliable each labeler is for each kind; the posteriors then train a
logistic span classifier on the votes, the span's layout and the words and characters
around it, which decides on the candidates that the strict patterns alone don't settle.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import slices, stored, table, trimmed

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "border")

# Gazetteers and context words.
_TLDS = frozenset("com org net edu gov mil int info biz io de fr es it nl uk us eu ca au jp cn in br ru ch at be se no fi dk pl pt mx example test".split())
_DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|mailto|write to|reach)\b"),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|client|ping|from)\b"),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pay|payment|cc)\b"),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|sms)\b"),
}
_AGAINST = re.compile(r"\b(?:version|ver|v|release|isbn|issn|section|chapter|invoice|order|part|model|serial)\b[^a-z]*$")

_ANY = re.compile(rb"[0-9@]|[\(\[]at[\)\]]| (?i:dot) |::")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The digit before a match is excluded as a longer run would have begun there; so each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MAYBE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,4}")
_MAYBE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_MAYBE_CARD = re.compile(r"(?<![0-9A-Za-z.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")
_MAYBE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

# First digits of 14-digit cards, first groups of assigned IPv6 blocks.
_CARD14 = re.compile(r"(?<![0-9A-Za-z.-])(?:30[0-5]|36|38|39)[0-9]{1,2}[ -]?[0-9]{6}[ -]?[0-9]{4}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:200[0-9A-Fa-f]|2[46]0[0-9A-Fa-f]|2[aA]0[0-9A-Fa-f]|[fF][cdCD][0-9A-Fa-f]{2}|[fF][eE]80)(?::[0-9A-Fa-f]{1,4}){0,6}::?(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])")
_SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} at [A-Za-z0-9-]{{1,63}}(?: dot [A-Za-z0-9-]{{1,63}}){{0,3}} dot (?:{'|'.join(sorted(_TLDS))})(?![A-Za-z0-9])", re.IGNORECASE)
_TRUNK = re.compile(rf"(?<![0-9A-Za-z+.-])00 ?(?:{'|'.join(_DIAL)})[ -]?(?:\([0-9]{{1,4}}\)[ -]?)?[0-9]{{2,4}}(?:[ -][0-9]{{2,4}}){{1,4}}(?![0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns, leftmost and without overlap for each kind, in code points."""
    out = []
    end, at = 0, t.find("@")
    while at >= 0:
        left = t[end:at]
        start = end + len(left.rstrip(_LOCAL))
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        end = m.end() if m else at + 1
        at = t.find("@", end)
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(t) if 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m.group())) <= 15]
    return out


def loose_spans(t: str) -> list[tuple[str, int, int]]:
    """Candidates that the strict patterns don't cover."""
    out = [("email", *m.span()) for m in _MAYBE_EMAIL.finditer(t)] if "at" in t else []
    out += [("phone", *m.span()) for m in _MAYBE_PHONE.finditer(t)]
    out += [("card", *m.span()) for m in _MAYBE_CARD.finditer(t)]
    out += [("ip", *m.span()) for m in _MAYBE_IP.finditer(t)] if ":" in t else []
    return out


def gazetteer_spans(t: str) -> list[tuple[str, int, int]]:
    """Candidates that only their listed parts give away: spelt-out domains, dial codes, card prefixes, address blocks."""
    out = [("email", *m.span()) for m in _SPELT.finditer(t)] if " dot " in t.lower() else []
    out += [("phone", *m.span()) for m in _TRUNK.finditer(t)] if "00" in t else []
    out += [("card", *m.span()) for m in _CARD14.finditer(t) if len(_digits(m.group())) == 14]
    out += [("ip", *m.span()) for m in _IPV6.finditer(t) if "::" in m.group()] if "::" in t else []
    return out


def apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans, in order, that overlap neither the taken ones nor one another."""
    ends, last = [], 0
    for b, e in sorted((b, e) for _, b, e in taken):
        last = max(last, e)
        ends.append((b, last))
    out: list[tuple[str, int, int]] = []
    for k, b, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        at = bisect_left(ends, (e,)) - 1  # the last taken one that begins before e; ends never fall
        if (at < 0 or ends[at][1] <= b) and (not out or out[-1][2] <= b):
            out.append((k, b, e))
    return out


def votes(t: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One of + 0 - for each labeler."""
    s, d = t[start:end], _digits(t[start:end])
    checksum, gazetteer = "0", "0"
    if kind == "email":
        tld = re.split(r"[.\s\])]+", s)[-1].lower()
        checksum = "+" if tld.isalpha() and len(tld) > 1 else "-"
        gazetteer = "+" if tld in _TLDS else "0"
    elif kind == "ip":
        if ":" not in s:
            parts = s.split(".")
            checksum = "-" if any(len(p) > 1 and p[0] == "0" for p in parts) else "+"
            gazetteer = "-" if parts[0].lstrip("0") in ("", "127", "255") else "0"
    elif kind == "card":
        checksum = "+" if _luhn(d) else "-"
        gazetteer = "+" if d[0] in "3456" else "0"
    else:
        checksum = "-" if len(set(d)) < 3 else "+" if len(d) >= 10 else "0"
        gazetteer = "+" if s[0] == "+" and d.startswith(_DIAL) or s.startswith("00") and d[2:].startswith(_DIAL) else "0"
    before = t[max(0, start - 32) : start].lower()
    context = "-" if _AGAINST.search(before) else "+" if _CONTEXT[kind].search(before) else "0"
    border = "-" if (start and t[start - 1].isalnum()) or (end < len(t) and t[end].isalnum()) else "+"
    return ("+" if strict else "0") + checksum + gazetteer + context + border


def _char(t: str, at: int) -> str:
    """Class of the character at a place: edge, blank, letter, digit, or itself if ASCII."""
    if not 0 <= at < len(t):
        return "edge"
    c = t[at]
    return "blank" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c if c < "\x7f" else "other"


def features(t: str, kind: str, start: int, end: int, v: str) -> list[str]:
    """What the classifier sees of a span: votes, length, layout, the characters at its borders, and the word before it in 256 buckets."""
    s = t[start:end]
    layout = re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), re.sub(r"[^\W0-9_]+", "a", s))[:16]
    word = re.findall(r"\w+", t[max(0, start - 32) : start].lower())[-1:]
    own = [f"{name}{c}" for name, c in zip(LABELERS, v)]
    own += [f"length{min((end - start) // 4, 9)}", f"marks{min(len({c for c in s if not c.isalnum()}), 4)}", f"layout:{layout}" if kind != "email" else "layout"]
    own += [f"before:{_char(t, start - 1)}", f"after:{_char(t, end)}", f"word:{zlib.crc32(word[0].encode()) % 256 if word else 'none'}"]
    return ["bias", kind, *(f"{kind}:{x}" for x in own)]


# Starting shares of votes for, by labeler, in true and in false spans.
_FOR_YES = np.array([0.9, 0.95, 0.9, 0.97, 0.9])
_FOR_NO = np.array([0.3, 0.4, 0.4, 0.05, 0.5])


def expectation_maximisation(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior that a span is personal data for each (kind, votes), from (kind, votes, count)."""
    out = {}
    for kind in KINDS:
        seen = sorted((v, n) for k, v, n in patterns if k == kind)
        if not seen:
            continue
        n = np.array([c for _, c in seen], float)
        for_, against = (np.array([[c == sign for c in v] for v, _ in seen], float) for sign in "+-")
        # Share of a labeler's votes that are for, given the truth; one that abstains (0) says nothing.
        yes, no = _FOR_YES.copy(), _FOR_NO.copy()
        prior = 0.5
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + for_ @ np.log(yes / no) + against @ np.log((1 - yes) / (1 - no))
            p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            # Pseudo-counts in the starting shares keep "yes" the side of agreeing labelers.
            yes = (for_.T @ (n * p) + 20 * _FOR_YES) / ((for_ + against).T @ (n * p) + 20)
            no = (for_.T @ (n * (1 - p)) + 20 * _FOR_NO) / ((for_ + against).T @ (n * (1 - p)) + 20)
            prior = min(((n * p).sum() + 10) / (n.sum() + 20), 0.8)  # no flood of good spans makes up for bad votes
        out |= {(kind, v): float(q) for (v, _), q in zip(seen, p)}
    return out


def train_classifier(counts: list[tuple[tuple[str, ...], float, int]], rounds: int = 400, rate: float = 2.0) -> dict[str, float]:
    """Logistic weights over span features, learnt from posteriors; counts: (features, posterior, count)."""
    counts = sorted(counts)
    names = sorted({c for f, _, _ in counts for c in f})
    at = {c: i for i, c in enumerate(names)}
    col = np.array([at[c] for f, _, _ in counts for c in f], np.int64)
    row = np.repeat(np.arange(len(counts)), [len(f) for f, _, _ in counts])
    y = np.array([p for _, p, _ in counts])
    n = np.log1p(np.array([c for *_, c in counts], float))  # rare patterns keep a say
    w = np.zeros(len(names))
    for _ in range(rounds if len(counts) else 0):
        part = (1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)), -50, 50))) - y) * n / n.sum()
        w -= rate * (np.bincount(col, part[row], len(names)) + 1e-4 * w)
    return dict(zip(names, w.tolist()))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,strict:boolean,votes:string,features:array<string>>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans: every strict, loose and gazetteer candidate with its votes and features."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.string()))]))

    def of(raw: bytes | None) -> list[tuple]:
        if not raw or not _ANY.search(raw):
            return []
        t = raw.decode("utf-8", "replace")
        strict = strict_spans(t)
        more = apart(loose_spans(t) + gazetteer_spans(t), strict)
        return [(k, s, e, own, v := votes(t, k, s, e, own), features(t, k, s, e, v)) for own, spans in ((True, strict), (False, more)) for k, s, e in spans]

    def run(it):
        for rb in it:
            for lo, hi, texts in slices(rb, 1, 4_000_000):
                spans = pa.array([[dict(zip(("kind", "start", "end", "strict", "votes", "features"), x)) for x in of(raw)] for raw in texts], type=kind)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(lo, hi - lo), spans], [id_col, "spans"])
        trimmed()

    source = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    schema = docs.sparkSession.createDataFrame([], f"spans {_SPAN}").schema
    return source.mapInArrow(run, type(schema)([source.schema[0], schema[0]]))


def _lowest(rows: DataFrame, wanted: int, n: int, bits: int = 12) -> DataFrame:
    """Rows with the `wanted` lowest values of the column h, and few others; n: number of rows.

    The border is narrowed by `bits` leading bits a pass, from counts of the rows by them, so
    that a sort of what is left takes about `wanted` rows from all tasks together.
    """
    fixed, prefix, below = 0, 0, 0  # leading bits that are fixed, their value at the border, rows below it
    high = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 4)  # 60 bits, in the order of h
    while n > 2 * wanted and fixed < 60:
        fixed += bits
        lead = F.shiftright(high, 60 - fixed)
        counts = rows.where(F.shiftright(lead, bits) == prefix).groupBy(lead.alias("lead")).count().collect()  # 2 ** bits rows
        for r in sorted(counts, key=lambda r: r["lead"]):
            prefix, n = r["lead"], below + r["count"]
            if n >= wanted:
                break
            below = n
    return rows.where(F.shiftright(high, 60 - fixed) <= prefix) if fixed else rows


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.9, max_train: int = 20_000) -> DataFrame:
    """Personal data in each row: id_col and spans (kind, start, end, strict, score), by kind as in KINDS, then start.

    Places are code points, ends exclusive.  Every span of the strict patterns stays; any other
    candidate that overlaps none of them is added where the span classifier gives it min_score.
    Null and empty texts have none; repeated rows each get their own; null ids stay null;
    without any candidate nothing is trained; other columns are ignored.

    Reliabilities come from the counts of all candidates' votes, at most 4 * 3**5 of them; the
    classifier learns from at most max_train candidates, those of the lowest hashes, and is
    applied to all.
    """
    found = stored(candidates(docs, id_col, text_col), "pii")
    each = found.select(F.explode("spans").alias("s"), F.xxhash64(F.col(id_col), F.lit(31)).alias("h"))
    votes_ = each.groupBy("s.kind", "s.votes").count().collect()
    posterior = expectation_maximisation([(r["kind"], r["votes"], r["count"]) for r in votes_])
    lowest = _lowest(each, max_train, sum(r["count"] for r in votes_))
    chosen = stored(lowest.select("s.kind", "s.votes", "s.features", "h", F.col("s.start").alias("at")).orderBy("h", "kind", "at", "votes").limit(max_train), "chosen").collect()  # max_train rows
    chosen.sort(key=lambda r: (r["h"], r["kind"], r["at"], r["votes"]))
    seen: dict[tuple[tuple[str, ...], float], int] = {}
    for r in chosen:
        key = (tuple(r["features"]), posterior[r["kind"], r["votes"]])
        seen[key] = seen.get(key, 0) + 1
    weights = F.from_json(F.lit(json.dumps(train_classifier([(f, p, n) for (f, p), n in seen.items()]))), "map<string,double>")
    sum_of = lambda f: F.aggregate(f, F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(weights, c), F.lit(0.0)))
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"), (1 / (1 + F.exp(-sum_of(s["features"])))).alias("score")))
    out = found.select(id_col, scored.alias("spans"))
    kept = F.filter("spans", lambda s: s["strict"] | (s["score"] >= min_score))
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["strict"].alias("strict"), s["score"].alias("score"))))
    return out.select(id_col, F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"), s["score"].alias("score"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == kind))).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["strict"])
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[dict[str, int], str]:
    """What the strict patterns give as they are written in the contract, for tests."""
    t, spans = text or "", []
    spans += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(_digits(m.group())) <= 19 and _luhn(_digits(m.group()))]
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(_digits(m.group())) <= 15]
    return {k: sum(s[0] == k for s in spans) for k in KINDS}, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()

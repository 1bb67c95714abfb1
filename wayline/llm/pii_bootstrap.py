"""Personal data, by fixed forms and by contexts that these induce.

Matches of fixed forms (base kinds, and long hexadecimal secrets) are seeds.
The words before a seed make a lexical pattern; identifier-like strings in the
same context are its other instances. Spark scores the graph of patterns and
instances in rounds: a pattern of a kind is as good as its scored instances
agree on that kind, an instance as good as its best pattern. Instances without
a score say nothing about a pattern. Patterns above a threshold, with several
different seeds, then mark instances of no fixed form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import pick, settle

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
# The forms of the contract. Each is matched so that time stays in proportion to the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")

DIGIT = re.compile("[0-9]")
#: Identifier-like: no blanks or quotes, from a letter or digit to one, with a digit inside.
TOKEN = re.compile(r"(?<![^\s\"'()\[\]{}<>,;:!?#*|=$&])[A-Za-z0-9+][^\s\"'()\[\]{}<>,;:!?#*|=$&]*")
ITEM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL:
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            end = m.end()
            out.append(("email", first, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    out: list[Span] = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[Span]:
    out: list[Span] = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and sum(LUHN[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += ips(text) + cards(text) + (phones(text) if "+" in text else [])
    return out


def secrets(text: str) -> list[Span]:
    return [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if not m[0].isdigit() and not m[0].isalpha()]


def context(text: str, start: int, reach: int = 80, items: int = 2) -> str:
    """The last two words or signs before a place, on its line; numbers look alike."""
    before = text[max(0, start - reach):start]
    before = before[before.rfind("\n") + 1:]
    return " ".join("0" if x.isdigit() else x.lower() for x in ["^", "^", *ITEM.findall(before)][-items:])


def identifiers(text: str, taken: list[Span], digits: int) -> list[tuple[int, int]]:
    """Identifier-like strings that no span overlaps."""
    out = []
    spans = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in TOKEN.finditer(text):
        a, b = m.start(), m.end()
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if sum("0" <= c <= "9" for c in text[a:b]) < digits:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k == len(spans) or spans[k][0] >= b:
            out.append((a, b))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


SEEN = "array<struct<first:long,last:long,kind:string,instance:long,pattern:string>>"
SCANNED = f"doc_id long, text_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, fixed string, seen {SEEN}"
STRUCT = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string()), ("instance", pa.int64()), ("pattern", pa.string())]))


def scanned(docs: DataFrame, digits: int) -> DataFrame:
    """docs: doc_id, text, text_id. Fixed forms of each text, and seeds and candidates with their contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, fixed, seen = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                n.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                some = DIGIT.search(text) is not None
                found = base + (secrets(text) if some else [])
                fixed.append(written(found))
                rows = [(k, a, b) for k, a, b in found] + [(None, a, b) for a, b in (identifiers(text, found, digits) if some else [])]
                seen.append([{"first": a, "last": b, "kind": k, "instance": xxhash.xxh64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")) - (1 << 63),
                              "pattern": context(text, a)} for k, a, b in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array([x[k] for x in n], pa.int64()) for k in range(4)), pa.array(digest, pa.string()),
                 pa.array(fixed, pa.string()), pa.array(seen, STRUCT)],
                ["doc_id", "text_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "fixed", "seen"])

    return docs.select("doc_id", "text", "text_id").mapInArrow(run, SCANNED)


def trusted_patterns(seen: DataFrame, rounds: int, least: int, support: int) -> DataFrame:
    """pattern, kind of the patterns whose confidence is at least `least` thousandths.

    A confidence is the sum of the scores of one kind over one more than the
    pattern's scored instances of all kinds: n seeds that agree make n / (n + 1),
    however many unseen instances share the pattern. Confidences and instance scores are whole thousandths, so that sums do not
    depend on their order. Equal confidences go to the smaller kind.
    """
    edges = settle(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    known = edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1000))
    seeded = edges.groupBy("pattern").agg(F.count("kind").alias("seeds")).where(F.col("seeds") >= support).select("pattern")
    edges = settle(edges.drop("kind").join(seeded, "pattern"))
    scores, trusted = known, None
    for _ in range(rounds):
        sums = (edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"))
                .groupBy("pattern").agg(F.sum("n").alias("scored"), F.collect_list(F.struct("sum", "kind")).alias("kinds")))
        best = sums.select("pattern", F.array_max(F.transform("kinds", lambda s: F.struct(
            F.floor(s["sum"] / (F.col("scored") + 1)).cast("int").alias("confidence"), s["kind"].alias("kind")))).alias("b")).select("pattern", "b.kind", "b.confidence")
        trusted = settle(best.where(F.col("confidence") >= least))
        found = (edges.select("pattern", "instance").join(trusted, "pattern").join(known.select("instance"), "instance", "left_anti")
                 .groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("score")))
        scores = settle(known.unionByName(found))
    return trusted.select("pattern", "kind")


def _marked(docs: DataFrame, rounds: int, confidence: float, support: int, digits: int) -> DataFrame:
    """scanned() with a row number and the spans that contexts add."""
    rows = settle(scanned(docs, digits).withColumn("row", F.monotonically_increasing_id()))
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    trusted = trusted_patterns(seen, rounds, round(1000 * confidence), support)
    added = (seen.where("kind is null").drop("kind").join(trusted, "pattern")
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last", "kind"))).alias("added")))
    return rows.drop("seen").join(added, "row", "left")


def _all_spans() -> F.Column:
    """Fixed and added spans as text, by kind as listed, then start."""
    split = F.transform(F.filter(F.split("fixed", ","), lambda s: s != ""), lambda s: F.struct(
        F.array_position(F.lit(list(KINDS)), F.split(s, ":")[0]).alias("kind"), F.split(s, ":")[1].cast("long").alias("first"), F.split(s, ":")[2].cast("long").alias("last")))
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<first:bigint,last:bigint,kind:string>>")),
                       lambda s: F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).alias("kind"), s["first"].alias("first"), s["last"].alias("last")))
    return F.array_join(F.transform(F.array_sort(F.concat(split, more)), lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["kind"].cast("int")), s["first"], s["last"])), ",")


def find(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4, digits: int = 4, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Personal data in every whole text, one row for each row of docs.

    n_email, n_ip, n_card, n_phone count the base matches and base_sha256 is a
    digest of their places; spans also has secrets and what contexts add, as
    kind:start:end in code points. A null text counts as empty; a null id stays
    null. confidence and support are what a pattern needs, digits what an
    identifier-like string has at least.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("text_id"))
    return (_marked(docs, rounds, confidence, support, digits)
            .select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _all_spans().alias("spans")))


def cut(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind; of overlapping ones the first and longest names the whole."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4, digits: int = 4, id_col: str = "doc_id",
           text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs, all columns as they were, with personal data in the text replaced by <KIND>. Null texts stay null.

    size_col, if given, is set to the new text's length.

    Fixed forms are found again where the text is; only spans added by context
    are joined, by the text's hash.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)
    text_id = F.xxhash64(F.col(f"c{at}"))
    marked = _marked(plain.select(F.col(f"c{key}").cast("long").alias("doc_id"), F.col(f"c{at}").alias("text"), text_id.alias("text_id")), rounds, confidence, support, digits)
    added = marked.where("added is not null").groupBy("text_id").agg(F.first("added").alias("added"))
    joined = plain.withColumn("text_id", text_id).join(added, "text_id", "left").select(*plain.columns, "added")
    names = plain.columns
    wide = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(wide).to_pylist()):
                if text is not None:
                    spans = base_spans(text) + (secrets(text) if DIGIT.search(text) else []) + [(s["kind"], s["first"], s["last"]) for s in more or []]
                    text = cut(text, spans) if spans else text
                new.append(text)
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(wide)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = joined.mapInArrow(run, plain.schema)
    if size_col:
        done = done.withColumn(f"c{docs.columns.index(size_col)}", F.length(f"c{at}").cast("long"))
    return done.toDF(*docs.columns)

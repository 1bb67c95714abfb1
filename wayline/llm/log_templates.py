"""Line dedup by a log-template tree, in DataFrame operations only.

A line's tokens that hold a digit are fields. The tree has two fixed levels: the
number of tokens, and the leading ones. In a leaf, the tokens after the leading
ones are cut into blocks, and a template is the line itself or the line with
one run of neighbouring blocks, three tenths of those tokens at most, made a
variable field. A leaf has as many templates as its lines make, and all its
families of lines are treated alike. A template met in several documents, and
with a constant token (beyond the leading ones, if it has a variable field), is
recurring: its lines are dropped from all but the document of smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import pick, settle

BLANKS = r"[ \t\r\x0B\f]+"
FIELD = "<*>"


def _masked(text: Column) -> Column:
    """The lines of a text with one blank between tokens, and <*> for each token that holds a digit."""
    def squeezed(line: Column) -> Column:
        odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0B") | line.contains("\f")
        return F.trim(F.when(odd, F.regexp_replace(line, BLANKS, " ")).otherwise(line))

    def masked(line: Column) -> Column:
        # A token begins where no other sign stands before it; possessive parts keep this linear.
        return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)

    return F.transform(F.transform(F.split(text, "\n", -1), squeezed), masked)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _constant(tokens: Column) -> Column:
    """Whether some token is not a field."""
    return F.size(F.array_remove(tokens, FIELD)) > 0


def _templates_of(masked: Column, depth: int, similarity: int) -> Column:
    """The templates (hashes) of a line."""
    def general(tokens: Column, cut: Column) -> Column:
        size, wide = cut["size"], cut["wide"]
        leaf = F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth))

        # Each block once: its hash, and whether it has a constant token.
        def block(k: Column) -> Column:
            return _bound(F.slice(tokens, depth + 1 + k * size, size), lambda t: F.struct(F.xxhash64(t).alias("h"), _constant(t).alias("constant")))

        def without(k: Column, blocks: Column) -> Column:
            rest = F.filter(blocks, lambda b, i: (i < k) | (i >= k + wide))
            return _bound(rest, lambda r: F.when(F.exists(r, lambda b: b["constant"]), F.xxhash64(leaf, k, F.transform(r, lambda b: b["h"]))))

        blocks = F.transform(F.sequence(F.lit(0), F.ceil(cut["free"] / size).cast("int") - 1), block)
        return _bound(blocks, lambda bs: F.transform(F.sequence(F.lit(0), F.size(bs) - wide), lambda k: without(k, bs)))

    def every(tokens: Column) -> Column:
        free = F.greatest(F.lit(0), F.size(tokens) - depth)
        most = F.floor(free * (100 - similarity) / 100).cast("int")
        cut = F.struct(free.alias("free"), F.greatest(F.lit(1), F.floor(most / 2).cast("int")).alias("size"), F.least(F.lit(2), most).alias("wide"))
        itself = F.array(F.when(_constant(tokens), F.xxhash64(masked)))
        return F.concat(itself, _bound(cut, lambda c: F.when(c["wide"] > 0, general(tokens, c)).otherwise(F.array().cast("array<bigint>"))))

    return F.filter(_bound(F.split(masked, " "), every), lambda t: t.isNotNull())


def _templates(docs: DataFrame, depth: int, similarity: int) -> DataFrame:
    """doc_id, text_id, no and the templates of every line with a token."""
    lines = docs.select("doc_id", "text_id", F.posexplode(_masked(F.col("text"))).alias("no", "masked")).where("masked <> ''")
    return lines.select("doc_id", "text_id", "no", _templates_of(F.col("masked"), depth, similarity).alias("templates"))


def dedup(docs: DataFrame, depth: int = 3, similarity: int = 70, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without recurring lines, one row for each row of docs.

    similarity is the least share, in hundredths, of the tokens after the
    leading ones that lines of a template with a variable field have in common;
    with fewer than four such tokens (at 70) a line is its only template. A line stays where
    its document is the first of every recurring template that it belongs to.
    Lines of fields only, and empty ones, stay. Null texts stay null and have no
    lines; an empty table gives none. Rows of one id are one document; rows
    without an id keep all their lines and do not make a template recurring.
    Other columns, whatever their names, are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))
    return _without(rows, _dropped(rows, depth, similarity)).select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.col("cleaned").alias("text"))


def _likely(each: DataFrame, recurring: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of each whose template may be recurring; most others need no exchange then.

    The low bits of recurring templates mark a table of 2**bits bits, broadcast
    as words of 64: 2**20 rows at most, whatever the number of templates.
    """
    word, bit = F.expr(f"shiftright(template & {(1 << bits) - 1}, 6)"), F.expr("cast(template & 63 as int)")
    words = recurring.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks"))
    met = each.withColumn("word", word).join(F.broadcast(words), "word").withColumn("bit", bit)
    return met.where("shiftright(marks, bit) & 1 = 1").select(*each.columns)


def _dropped(rows: DataFrame, depth: int, similarity: int) -> DataFrame:
    """doc_id, text_id and the places of the lines to drop."""
    keys = settle(_templates(rows.where("doc_id is not null"), depth, similarity).withColumn("row", F.monotonically_increasing_id()))
    each = keys.select("doc_id", "row", F.explode("templates").alias("template"))
    # Stored, so that the join below has an exchange of its own on both sides, which Spark can split at a common template.
    recurring = settle(each.groupBy("template").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner <> hi").select("template", "owner"))
    lines = _likely(each, recurring).join(recurring, "template").where("doc_id <> owner").select("row").distinct()
    return keys.select("doc_id", "text_id", "no", "row").join(lines, "row", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_list("no").alias("gone"))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows with n_lines, kept (places of the lines that stay) and cleaned."""
    split = F.split("text", "\n", -1)
    joined = rows.join(dropped, ["doc_id", "text_id"], "left")
    every = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.when(F.col("text").isNull(), F.array().cast("array<int>")).when(F.col("gone").isNull(), every).otherwise(F.array_except(every, "gone"))
    return (joined.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")).withColumn("kept", kept)
            .withColumn("cleaned", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get(split, i)), "\n"))))


def drop_lines(docs: DataFrame, depth: int = 3, similarity: int = 70, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs, all columns as they were, without recurring lines.

    Documents of which no line with a token is left go, if they had one;
    size_col, if given, is set to the new text's length.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = (plain.withColumn("doc_id", F.col(f"c{names.index(id_col)}").cast("long")).withColumn("text", F.col(f"c{names.index(text_col)}"))
            .withColumn("text_id", F.xxhash64("text")))
    done = _without(rows, _dropped(rows.select("doc_id", "text", "text_id"), depth, similarity)).where(F.col("gone").isNull() | F.col("cleaned").rlike(r"[^ \t\r\x0B\f\n]"))
    new = {text_col: F.col("cleaned")} | ({size_col: F.length("cleaned").cast("long")} if size_col else {})
    return done.select(*[new[n] if n in new else F.col(f"c{i}") for i, n in enumerate(names)]).toDF(*names)


def oracle(depth: int = 3, similarity: int = 70) -> str:
    return f"""
    with texts as (select row_number() over () as r, doc_id, "text" from documents),
    raw as (select r, doc_id, generate_subscripts(l, 1) - 1 as no, unnest(l) as raw from (select r, doc_id, string_split("text", chr(10)) as l from texts)),
    squeezed as (select r, doc_id, no, trim(regexp_replace(raw, '[ \\t\\r\\x0B\\f]+', ' ', 'g')) as s from raw),
    lines as (select r, doc_id, no, string_split(regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') as t from squeezed where s <> ''),
    sized as (select *, greatest(0, len(t) - {depth}) as free, (greatest(0, len(t) - {depth}) * {100 - similarity}) // 100 as most from lines),
    cut as (select *, greatest(1, most // 2) as size, least(2, most) as wide from sized),
    placed as (select *, unnest(range(0, (free + size - 1) // size - wide + 1)) as k from cut where wide > 0),
    general as (select r, doc_id, no, t[1:{depth} + k * size] as before, t[{depth} + 1 + (k + wide) * size:] as after, len(t) as n, k from placed),
    templates as (
        select r, doc_id, no, 'line ' || array_to_string(t, ' ') as template from lines where len(list_filter(t, lambda x: x <> '<*>')) > 0
        union all
        select r, doc_id, no, n || ' ' || k || ' ' || array_to_string(before, ' ') || ' | ' || array_to_string(after, ' ') from general
        where len(list_filter(list_concat(before[{depth} + 1:], after), lambda x: x <> '<*>')) > 0),
    recurring as (select template, min(doc_id) as owner from templates group by template having min(doc_id) <> max(doc_id)),
    gone as (select distinct r, no from templates join recurring using (template) where doc_id <> owner),
    kept as (select w.r, string_agg(raw, chr(10) order by no) as cleaned, count(*) as n from raw w anti join gone g using (r, no) group by w.r)
    select t.doc_id, cast(coalesce(len(string_split(t."text", chr(10))), 0) as bigint) as n_lines,
           cast(coalesce(len(string_split(t."text", chr(10))), 0) - coalesce(k.n, 0) as bigint) as n_dropped,
           case when t."text" is null then null else coalesce(k.cleaned, '') end as text
    from texts t left join kept k using (r)"""

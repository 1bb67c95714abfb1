"""Point-of-interest catalogue: validation, search and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.display import fixed
from wayline.functions.text import stripped
from wayline.operators.ordered import Walk, last_known, row_index

# Categories in display order with label and colour, and the names
# older catalogues used.
CATEGORIES = [
    ("", "Uncategorized", "#7E8B97"),
    ("hidden", "Hidden", "#19C28A"),
    ("cave", "Cave", "#6FE8FF"),
    ("circuit", "Circuit", "#D9A368"),
    ("tactical", "Tactical", "#E5484D"),
    ("industry", "Industry", "#F97316"),
    ("logistics", "Logistics", "#A78BFA"),
    ("loot", "Loot", "#FBBF24"),
    ("racing", "Racing", "#86EFAC"),
]
OLD_CATEGORIES = {
    "exploration": "cave",
    "logistics_black_market": "logistics",
    "hostile_combat": "tactical",
}
KINDS = ["surface", "space"]
REQUIRED = ["name", "x", "y", "z", "location", "kind"]
WIRE = ["name", "x", "y", "z", "location", "ooc", "kind", "category", "description"]
IDENTITY = ["name", "x", "y", "z"]


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, label string, colour string")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OLD_CATEGORIES.items()), "alias string, canonical string")


def accepted_slugs(spark: SparkSession) -> DataFrame:
    return (category_table(spark).select("category")
            .union(alias_table(spark).select("alias")).distinct())


def with_category(df: DataFrame) -> DataFrame:
    """Label and colour of the canonical category; unknown ones get the default.

    Both dimension tables are constants of a dozen rows, hence the broadcasts.
    """
    spark = df.sparkSession
    aliases, cats = F.broadcast(alias_table(spark)), F.broadcast(category_table(spark))
    slug = F.coalesce("category", F.lit(""))
    default = CATEGORIES[0]
    named = (df.withColumn("_slug", slug).join(aliases, F.col("_slug") == F.col("alias"), "left")
             .withColumn("_slug", F.coalesce("canonical", "_slug")).drop("alias", "canonical"))
    return (named.join(cats.withColumnRenamed("category", "_key"), F.col("_slug") == F.col("_key"), "left")
            .withColumn("label", F.coalesce("label", F.lit(default[1])))
            .withColumn("colour", F.coalesce("colour", F.lit(default[2])))
            .select(*df.columns, "label", "colour"))


def _or(value: Column, default: str) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def wire_form(df: DataFrame) -> DataFrame:
    """The exchange schema with its defaults; null and empty text are replaced alike."""
    have = set(df.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    return df.select(
        F.coalesce(c("name").cast("string"), F.lit("")).alias("name"),
        *[F.coalesce(c(a).cast("double"), F.lit(0.0)).alias(a) for a in "xyz"],
        _or(c("location").cast("string"), "Unknown").alias("location"), c("ooc").cast("string").alias("ooc"),
        _or(c("kind").cast("string"), "space").alias("kind"),
        _or(c("category").cast("string"), "").alias("category"),
        _or(c("description").cast("string"), "").alias("description"))


def loaded_form(df: DataFrame) -> DataFrame:
    """Catalogue defaults on load. A declared schema cannot tell a missing key
    from a null, so both take the default; empty text is kept."""
    fill = {"name": "Unknown", "description": "", "location": "Unknown", "kind": "space", "category": ""}
    return df.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill
                       else F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in "xyz" else F.col(c)
                       for c in WIRE])


def validation_error(fields: dict[str, Column]) -> Column:
    """Message of the first rule a raw entry breaks, or null. Fields are text columns."""
    missing = None
    for name in REQUIRED:
        rule = F.lit(f"Missing required field: '{name}'.")
        missing = F.when(fields[name].isNull(), rule) if missing is None else missing.when(fields[name].isNull(), rule)
    kind = F.lower(stripped(fields["kind"]))
    category = stripped(F.coalesce(fields["category"], F.lit("")))
    numeric = fields["x"].try_cast("double").isNotNull()
    for a in "yz":
        numeric = numeric & fields[a].try_cast("double").isNotNull()
    slugs = [c for c, _, _ in CATEGORIES] + list(OLD_CATEGORIES)
    expected = ", ".join(sorted(s for s in slugs if s))
    return (missing
            .when(stripped(fields["name"]) == "", F.lit("Field 'name' must not be empty."))
            .when(~numeric, F.lit("Fields x/y/z must be numeric."))
            .when(~kind.isin(KINDS), F.concat(F.lit("Field 'kind' must be 'surface' or 'space' (got '"), kind, F.lit("').")))
            .when(~category.isin(slugs), F.concat(F.lit("Unknown category '"), category,
                                                  F.lit(f"'. Expected one of: {expected}."))))


def validate(df: DataFrame) -> DataFrame:
    """Add ``error``; valid rows come out trimmed and typed, others keep null fields."""
    text = {c: F.col(c).cast("string") for c in WIRE if c in df.columns}
    for c in WIRE:
        text.setdefault(c, F.lit(None).cast("string"))
    judged = df.withColumn("error", validation_error(text))
    ok = F.col("error").isNull()
    clean = {
        "name": stripped(text["name"]), **{a: text[a].try_cast("double") for a in "xyz"},
        "location": _or(stripped(text["location"]), "Unknown"),
        "ooc": F.when(text["ooc"] != "", stripped(text["ooc"])), "kind": F.lower(stripped(text["kind"])),
        "category": stripped(F.coalesce(text["category"], F.lit(""))),
        "description": stripped(F.coalesce(text["description"], F.lit("")))}
    others = [c for c in df.columns if c not in WIRE]
    return judged.select(*others, *[F.when(ok, v).alias(c) for c, v in clean.items()], "error")


def validate_documents(entries: DataFrame, doc: list[str], pos: str = "pos") -> DataFrame:
    """All-or-nothing per document: one bad entry rejects it, reported as ``Entry #n``."""
    told = F.concat(F.lit("Entry #"), (F.col(pos) + 1).cast("string"), F.lit(": "), F.col("error"))
    bad = F.when(F.col("error").isNotNull(), F.col(pos))
    return (entries.groupBy(*doc).agg(F.count(F.lit(1)).alias("entries"), F.min_by(told, bad).alias("error"))
            .withColumn("accepted", F.col("error").isNull()))


RAW_ENTRY = ", ".join(f"{c} string" for c in WIRE)


def parse_documents(docs: DataFrame, doc: list[str], text: str, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON documents (one object or an array of them) → validated entries, verdict per document."""
    body = stripped(F.col(text))
    as_list = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).when(body.startswith("["), body)
    items = F.from_json(as_list, f"array<struct<{', '.join(f'{c}: string' for c in WIRE)}>>")
    read = docs.select(*doc, body.alias("_body"), items.alias("_items"))
    what = "Clipboard is empty." if single else "File is empty."
    problem = (F.when(F.col("_body").isNull() | (F.col("_body") == ""), F.lit(what))
               .when(~F.col("_body").rlike(r"^[\[{]"), F.lit("JSON root must be an object or an array."))
               .when(F.col("_items").isNull(), F.lit("Not a valid JSON document."))
               .when(F.lit(single) & (F.size("_items") != 1), F.lit("JSON array must contain exactly one POI."))
               .when(F.size("_items") == 0, F.lit("JSON array is empty — nothing to import.")))
    read = read.withColumn("_problem", problem)
    rows = (read.filter(F.col("_problem").isNull()).select(*doc, F.posexplode("_items").alias("pos", "_e"))
            .select(*doc, "pos", "_e.*"))
    entries = validate(rows)
    verdicts = validate_documents(entries, doc).select(*doc, "accepted", "error")
    refused = read.filter(F.col("_problem").isNotNull()).select(
        *doc, F.lit(False).alias("accepted"), F.col("_problem").alias("error"))
    return entries, verdicts.unionByName(refused)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine; together they are the input."""
    return (validated.filter(F.col("error").isNull()).drop("error"),
            validated.filter(F.col("error").isNotNull()))


def in_category(df: DataFrame, slug: str) -> DataFrame:
    return df.filter(F.col("category") == slug)


def _plain_number(v: Column) -> Column:
    """A double without exponent, as far as 18 digits before and after the point hold it."""
    digits = F.regexp_replace(v.try_cast("decimal(36,18)").cast("string"), "0+$", "")
    return F.coalesce(F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits), v.cast("string"))


def search(df: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring over name, description, coordinates and category label."""
    if not needle:
        return df
    low = F.lit(needle.lower())
    found = F.lower("label").contains(low)
    for c in ("name", "description"):
        if c in df.columns:
            found = found | F.lower(F.coalesce(c, F.lit(""))).contains(low)
    for c in "xyz":
        found = found | _plain_number(F.col(c)).contains(low)
    return with_category(df).filter(found).drop("label", "colour")


def listing(df: DataFrame) -> DataFrame:
    """Catalogue as shown: upper-case label, two decimals, zone or ``(legacy)``, by name."""
    shown = [F.coalesce(fixed(F.col(a), 2), F.lit("?")).alias(a) for a in "xyz"]
    zone = F.when(F.coalesce("ooc", F.lit("")) == "", F.lit("(legacy)")).otherwise(F.col("ooc"))
    return (with_category(df).select("name", zone.alias("zone"), F.upper("label").alias("category"), "colour", *shown)
            .orderBy("name"))


def duplicates(imported: DataFrame, existing: DataFrame) -> DataFrame:
    """Imported rows whose name is taken, ignoring case."""
    taken = existing.select(F.lower("name").alias("_n")).distinct()
    return imported.join(taken, F.lower(imported["name"]) == F.col("_n"), "left_semi")


#: Names or numbers of one base that stand in one block of a running value.
NAME_BLOCK = 65536.0
_NUMBERED = r"(?s)^(.*) \(([1-9]\d{0,17})\)$"


def free_numbers(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """``number`` for every ``(base, k)``: the k-th number from 2 on that is not among the base's used ones.

    ``used``: ``base, i``, each once. The r-th used number i has i - 1 - r unused
    ones below it; the largest r for which these are fewer than k gives k + 1 + r.
    Found by one ordered pass over used and wanted numbers of a base, in blocks.
    """
    ranked = Walk.along(used.filter(F.col("i") >= 2), ("base",), ("i",), NAME_BLOCK).add(r=row_index())
    gaps = ranked.select("base", (F.col("i") - F.col("r")).alias("_at"), F.lit(0).alias("_rank"), "r", F.lit(None).cast("bigint").alias("k"))
    asked = wanted.select("base", F.col("k").alias("_at"), F.lit(1).alias("_rank"), F.lit(None).cast("bigint").alias("r"), "k")
    met = Walk.along(gaps.unionByName(asked), ("base",), ("_at", "_rank", "r"), NAME_BLOCK).add(below=last_known(F.col("r")))
    return met.rows.filter("_rank = 1").select("base", "k", (F.col("k") + 1 + F.coalesce("below", F.lit(0))).alias("number"))


def used_numbers(*catalogues: DataFrame, name: str = "name") -> DataFrame:
    """``base, i`` of all names of the form ``base (i)``, in lower case; longer numbers are never reached."""
    lows = [c.select(F.lower(F.col(name)).alias("n")) for c in catalogues]
    every = lows[0] if len(lows) == 1 else lows[0].union(lows[1])
    return (every.filter(F.col("n").rlike(_NUMBERED))
            .select(F.regexp_extract("n", _NUMBERED, 1).alias("base"), F.regexp_extract("n", _NUMBERED, 2).cast("bigint").alias("i")).distinct())


def next_free_names(wanted: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """``name (i)`` with the smallest unused ``i >= 2``, ignoring case, for each different name."""
    names = wanted.select(name, F.lower(name).alias("base")).distinct()
    free = free_numbers(names.select("base", F.lit(1).cast("bigint").alias("k")).distinct(), used_numbers(existing, name=name))
    return (names.join(free, "base")
            .select(name, F.concat(F.col(name), F.lit(" ("), F.col("number").cast("string"), F.lit(")")).alias("free_name")))


def upsert(existing: DataFrame, imported: DataFrame, policy: str, position: str = "pos", arrival: str | None = None) -> DataFrame:
    """Import rows one after another into a catalogue; on a taken name replace, keep both, or abort.

    ``position`` orders the catalogue, ``arrival`` (a number) the imports; without
    it they come as they stand. A name that the import itself repeats is taken
    from its second row on. ``replace`` removes the first row of the name, so
    that of m old and k new ones the last max(m, 1) stay. ``keep_both`` gives the
    k-th such row the k-th number that no name has, neither in the catalogue nor
    literally in the import. ``abort`` adds a name once, where it is free.
    """
    keys = ("_n",)
    old = existing.withColumn("_n", F.lower("name"))
    new = (imported.withColumn("_a", F.col(arrival) if arrival else F.monotonically_increasing_id()).withColumn("_n", F.lower("name")))
    told = Walk.along(new, keys, ("_a",), NAME_BLOCK).add(_k=row_index()).rows
    have = old.groupBy("_n").agg(F.count(F.lit(1)).alias("_m"))
    came = new.groupBy("_n").agg(F.count(F.lit(1)).alias("_came"))
    told = told.join(have, "_n", "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    keep = old
    if policy == "abort":
        add = told.filter("_m = 0 and _k = 1")
    elif policy == "keep_both":
        asked = told.withColumn("k", F.col("_k") - F.when(F.col("_m") > 0, 0).otherwise(1))
        numbers = free_numbers(asked.filter("k > 0").select(F.col("_n").alias("base"), "k"), used_numbers(existing, imported))
        numbered = F.concat(F.col("name"), F.lit(" ("), F.col("number").cast("string"), F.lit(")"))
        add = (asked.join(numbers.withColumnRenamed("base", "_n"), ["_n", "k"], "left")
               .withColumn("name", F.when(F.col("k") > 0, numbered).otherwise(F.col("name"))))
    elif policy == "replace":
        ranked = Walk.along(old, keys, (position,), NAME_BLOCK).add(_r=row_index()).rows
        keep = ranked.join(came, "_n", "left").filter(F.col("_r") > F.coalesce("_came", F.lit(0)))
        add = told.join(came, "_n").filter(F.col("_k") > F.col("_came") - F.greatest(F.col("_m"), F.lit(1)))
    else:
        raise ValueError(f"unknown conflict policy: {policy}")
    filled = add.withColumn("kind", _or(F.col("kind"), "space"))
    cols = [c for c in existing.columns if c != position]
    return keep.select(*cols).unionByName(filled.select(*cols))


def delete_matching(existing: DataFrame, doomed: DataFrame) -> DataFrame:
    """Drop every row equal on name and coordinates."""
    return existing.join(doomed.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def update_first(existing: DataFrame, changes: DataFrame, position: str = "pos") -> DataFrame:
    """Merge supplied (non-null) fields into the first row equal on name and coordinates."""
    fields = [c for c in changes.columns if c not in IDENTITY]
    first = existing.groupBy(*IDENTITY).agg(F.min(position).alias(position))
    hits = first.join(changes, IDENTITY).select(position, *[F.col(c).alias(f"_new_{c.removeprefix('new_')}") for c in fields])
    merged = existing.join(hits, position, "left")
    supplied = {c.removeprefix("new_") for c in fields}
    return merged.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in supplied else F.col(c)
                           for c in existing.columns])


# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------

# Default, lowest and highest accepted value (null: unbounded).
LIMITS = {
    "max_speed_km_s": (2.5, 0.1, 50.0),
    "sigma_a": (1.0, 0.001, 100.0),
    "sigma_z": (0.02, 0.0001, 10.0),
    "gate_nis": (30.0, 0.1, 100000.0),
    "coast_s": (2.0, 0.0, 30.0),
    "arrival_radius_m": (400.0, 1.0, None),
    "min_confidence": (0.30, 0.0, 1.0),
}


def clamp_parameter(name: Column, text: Column) -> Column:
    """Typed parameter inside its limits; unreadable text gives the default."""
    out = None
    for key, (default, low, high) in LIMITS.items():
        value = F.greatest(F.lit(low), F.coalesce(text.try_cast("double"), F.lit(default)))
        value = F.least(F.lit(high), value) if high is not None else value
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out


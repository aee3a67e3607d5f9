"""Tag texts by a table of rules of any length.

Every rule is filed under one stretch of ``GRAM`` letters of its phrase, the one that the
fewest texts hold, or the whole phrase if it is shorter. Texts give their distinct stretches, an
equi-join meets them with the rules filed there, and only those are looked for in the text. No
text is held against all rules, and the table is never collected; it is broadcast only if it is
measured as small. Then texts are dealt out by themselves first, so that their stretches, which
are many times as long as they are, meet the rules and are grouped again without a shuffle. Else the
stretches are shuffled to the rules.

How many texts hold a stretch is counted over one text in ``SAMPLED``. That count decides which
stretch a rule is filed under, so it changes the cost and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

GRAM = 4
SAMPLED = 16
#: Rows with the same text are dealt into so many groups, so that copies do not crowd a task.
SLICES = 64
#: Rules, and bytes of their phrases and tags, up to which a table is small.
SMALL_RULES, SMALL_BYTES = 1 << 16, 8 << 20


def _grams(text: Column, sizes: list[int]) -> Column:
    """The hashes of the distinct stretches of the given numbers of letters."""
    parts = [
        # An empty match before each letter, with the letters that follow in a group.
        F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)),
                    lambda gram: F.xxhash64(gram))
        for size in sizes
    ]
    return F.array_distinct(F.concat(*parts))


def checked(rules: DataFrame) -> tuple[DataFrame, list[int], bool]:
    """The rules, the lengths of stretches they need and whether the table is small; a null or
    a priority that two rules share is an error."""
    rules = rules.select(F.col("priority").cast("bigint").alias("priority"), "pattern", "tag")
    row = rules.agg(
        F.count("*").alias("n"), F.count_distinct("priority").alias("priorities"),
        F.count_if(F.col("priority").isNull() | F.col("pattern").isNull() | F.col("tag").isNull()
                   ).alias("nulls"),
        F.collect_set(F.least(F.char_length("pattern"), F.lit(GRAM))).alias("sizes"),
        F.sum(F.octet_length("pattern") + F.octet_length("tag")).alias("bytes"),
    ).first()
    if row["nulls"]:
        raise ValueError("a rule has a null")
    if row["priorities"] != row["n"]:
        raise ValueError("rule priorities must differ")
    small = row["n"] <= SMALL_RULES and (row["bytes"] or 0) <= SMALL_BYTES
    return rules, sorted(size for size in row["sizes"] if size), small


def _filed(rules: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``gram, rule``: every rule under its rarest stretch."""
    size = F.least(F.char_length("pattern"), F.lit(GRAM))
    grams = F.lit(None).cast("array<bigint>")
    for n in sizes:
        grams = F.when(size == n, _grams(F.col("pattern"), [n])).otherwise(grams)
    grams = rules.where("pattern <> ''").select(
        F.struct("priority", "pattern", "tag").alias("rule"), F.explode(grams).alias("gram"))
    few = texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0)
    held = few.select(F.explode(_grams(F.col("text"), sizes)).alias("gram")).join(
        grams.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(held, "gram", "left").groupBy("rule").agg(F.min(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("gram"), "gram")).alias("least"))
    return rarest.select("least.gram", "rule")


def tag_by_table(
    df: DataFrame, text: str, rules: DataFrame, default: str, *, name: str = "tag",
) -> DataFrame:
    """Add the tag of the rule with the lowest priority number whose ``pattern`` is in ``text``.

    ``rules`` has columns ``priority``, ``pattern`` and ``tag``. A null text gets the default, an
    empty phrase is in every text; ``df`` keeps its columns, whatever their names.
    """
    rules, sizes, small = checked(rules)
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = df.select(
        F.struct(*[F.col(c) for c in df.columns if c != name]).alias("row"),
        F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("key"),
        F.pmod(F.xxhash64(*hashable), F.lit(SLICES)).alias("slice"))
    everywhere = rules.where("pattern = ''").agg(F.min(F.struct("priority", "tag")).alias("r")).first()["r"]
    always = F.lit(None).cast("struct<priority:bigint,tag:string>")
    if everywhere is not None:
        always = F.when(F.col("text").isNotNull(), F.struct(
            F.lit(everywhere["priority"]).cast("bigint").alias("priority"),
            F.lit(everywhere["tag"]).alias("tag")))
    if sizes:
        filed = _filed(rules, keyed, sizes)
        if small:
            keyed, filed = keyed.repartition("key", "slice"), F.broadcast(filed)
        met = keyed.select("key", "slice", F.explode(_grams(F.col("text"), sizes)).alias("gram")).join(
            filed, "gram")
        # Copies of a text in one slice meet the same rules.
        met = met.groupBy("key", "slice").agg(F.collect_set("rule").alias("rules"))
        keyed = keyed.join(met, ["key", "slice"], "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast(
            "array<struct<priority:bigint,pattern:string,tag:string>>"))
    # In order of the priority, so that after the first rule found no other is looked for.
    found = F.aggregate(
        F.array_sort("rules"), F.lit(None).cast("struct<priority:bigint,tag:string>"),
        lambda first, rule: F.when(first.isNotNull(), first).when(
            F.contains(F.col("text"), rule["pattern"]),
            F.struct(rule["priority"].alias("priority"), rule["tag"].alias("tag"))))
    first = F.least(found, always)
    return keyed.select("row.*", F.coalesce(first["tag"], F.lit(default)).alias(name))

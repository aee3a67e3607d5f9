"""Line dedup: boilerplate lines by how many sites and contexts they are spread over.

A line is spread if it stands on at least ``min_sites`` sites. Spread lines are boilerplate if they
stand in at least ``min_contexts`` different contexts and in at least half as many contexts as
different texts. The context of a line is what else its text holds: the other lines that are
not spread. So the lines of a template are told by the pages they are in, not by each other.

Edited copies of a text share most lines too, and differ in the edited ones; but those are
nearly the same. So a context is not these lines as such: it is the least of the pairs of
neighbouring words in them, by hash, which an edit in the line mostly leaves. There are ``HASHES`` hashes,
and a line's contexts are the most that any of them tells apart, as one alone may be least
for a pair that many pages hold. Where spread lines are all but a ninth of a text's lines, two such texts
would be near copies of similarity 0.8 or more; then the context is the least and greatest of the spread
lines. So neither copies nor edited copies make the lines of their text boilerplate, and copies do not
count as texts.

Sites and contexts are counted by HyperLogLog sketches per line, which aggregation merges.
Lines whose estimates are within a quarter of a threshold get exact distinct counts. With
2**12 registers the standard error is 1.6 %, so what lies outside of that band is at least
12 standard errors away; the sketches of few values are nearly exact.

Defined results: lines are compared without spaces, tabs and carriage returns around them;
empty lines are no lines and stay; a null text stays null and an empty one empty; a text of
boilerplate only becomes empty, its row stays; a line repeated in a document counts once
and is removed everywhere; a null site is a site of its own. All columns stay as they are, whatever
their names, but for the two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewharf.llm.common import let, saved

MIN_SITES = 5
MIN_CONTEXTS = 10
LG_REGISTERS = 12
#: Where in the MD5 of a pair of words each hash of 16 digits begins.
HASHES = (1, 6, 11, 16)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    """The MD5 of each line, null for empty ones."""
    return F.transform(_lines(text), lambda line: F.when(_bare(line) != "", F.md5(_bare(line))))


def _distinct_keys(text: Column) -> Column:
    return F.array_distinct(F.array_compact(_keys(text)))


def _near(estimate: Column, threshold: Column) -> Column:
    return (estimate * 5 >= threshold * 4) & (estimate * 4 <= threshold * 5)


def _estimate(column: str) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(LG_REGISTERS)))


def spread_lines(
    documents: DataFrame, text_col: str, site_col: str, min_sites: int = MIN_SITES,
) -> DataFrame:
    """``line``: the MD5 of each line that stands on enough sites."""
    seen = documents.select(
        # Sketches do not count empty strings.
        F.concat(F.lit("="), F.coalesce(F.col(site_col).cast("string"), F.lit(""))).alias("site"),
        F.explode(_distinct_keys(F.col(text_col))).alias("line"))
    sites = saved(
        seen.groupBy("line").agg(F.count("*").alias("n"), _estimate("site").alias("sites"))
        # Estimates are within the band of the truth, so the rest is surely below the threshold.
        .where((F.col("n") >= min_sites) & (F.col("sites") * 5 >= min_sites * 4)), "sites")
    unsure = _near(F.col("sites"), F.lit(min_sites))
    exact = seen.join(sites.where(unsure).select("line"), "line", "left_semi").groupBy("line").agg(
        F.count_distinct("site").alias("sites"))
    enough = F.col("sites") >= min_sites
    return saved(sites.where(~unsure & enough).select("line").unionAll(
        exact.where(enough).select("line")), "spread")


def _spread_in_texts(documents: DataFrame, text_col: str, spread: DataFrame) -> DataFrame:
    """``text_key, spread, contexts``: a row for every different text with spread lines."""
    text = F.col(text_col)
    keyed = documents.select(F.md5(text).alias("text_key"), text.alias("text"))
    lines = keyed.select("text_key", F.explode(_distinct_keys(F.col("text"))).alias("line"))
    # A line's text once in a task; copies have the same spread lines.
    held = saved(lines.join(spread, "line").groupBy("text_key").agg(
        F.collect_set("line").alias("spread")), "held")
    # The words of a text are paired and hashed once, however many copies it has.
    found = keyed.join(held, "text_key").groupBy("text_key").agg(
        F.first("text").alias("text"), F.first("spread").alias("spread"))
    ends = F.concat(F.lit("s"), F.array_min("spread"), F.array_max("spread"))

    def least(lines: Column) -> Column:
        own = F.filter(lines, lambda line: ~F.array_contains(F.col("spread"), line["key"]))
        alike = F.size("spread") * 9 >= F.size(F.array_distinct(lines["key"])) * 8
        return F.when(alike, F.array(*[ends] * len(HASHES))).otherwise(
            let(F.flatten(F.transform(own, lambda line: _pairs(line["bare"]))), _least))

    return found.select("text_key", "spread", let(_keyed_lines(F.col("text")), least).alias("least")).select(
        "text_key", "spread", *[F.col("least")[i].alias(f"context{at}") for i, at in enumerate(HASHES)])


def _keyed_lines(text: Column) -> Column:
    """The lines that are not empty, without white space around them, and their MD5."""
    bare = F.filter(F.transform(_lines(text), _bare), lambda line: line != "")
    return F.transform(bare, lambda line: F.struct(line.alias("bare"), F.md5(line).alias("key")))


def _pairs(line: Column) -> Column:
    """The MD5 of each pair of neighbouring words, of one word alone if there is no other."""
    return let(F.filter(F.split(line, r"[ \t\r]+", -1), lambda w: w != ""), lambda words: F.when(
        F.size(words) == 1, F.array(F.md5(words[0]))).otherwise(F.zip_with(
            F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
            lambda word, after: F.md5(F.concat(word, F.lit(" "), after)))))


def _least(pairs: Column) -> Column:
    """The least of the pairs by each hash."""
    return F.array(*[F.substring(F.array_min(pairs), at, 16) if at == 1 else F.array_min(
        F.transform(pairs, lambda pair: F.substring(pair, at, 16))) for at in HASHES])


def _boilerplate(texts: DataFrame, min_contexts: int) -> DataFrame:
    """``line``: those of the spread lines that are in enough contexts."""
    names = [f"context{at}" for at in HASHES]
    held = texts.select(*names, F.explode("spread").alias("line"))
    counts = saved(held.groupBy("line").agg(
        F.count("*").alias("n"), F.greatest(*map(_estimate, names)).alias("contexts")), "contexts")
    need = F.greatest(F.lit(float(min_contexts)), F.col("n") / 2)
    unsure = _near(F.col("contexts"), need)
    close = held.join(counts.where(unsure).select("line"), "line", "left_semi")
    exact = close.select("line", F.explode(F.array(*[F.struct(
        F.lit(at).alias("at"), F.col(f"context{at}").alias("context")) for at in HASHES])).alias("c")).groupBy(
        "line", "c.at").agg(F.count("*").alias("n"), F.count_distinct("c.context").alias("contexts")).groupBy(
        "line").agg(F.max("n").alias("n"), F.max("contexts").alias("contexts"))
    enough = F.col("contexts") >= need
    return saved(counts.where(~unsure & enough).select("line").unionAll(
        exact.where(enough).select("line")), "boilerplate")


def boilerplate(documents: DataFrame, *, text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``line``: the MD5 of each boilerplate line."""
    spread = spread_lines(documents, text_col, site_col, min_sites)
    return _boilerplate(saved(_spread_in_texts(documents, text_col, spread), "texts"), min_contexts)


def remove_boilerplate(documents: DataFrame, *, text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS,
                       lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """All columns of ``documents``, the text without boilerplate lines, and two counts.

    Columns with the names of the counts are replaced.
    """
    spread = spread_lines(documents, text_col, site_col, min_sites)
    texts = saved(_spread_in_texts(documents, text_col, spread), "texts")
    found = _boilerplate(texts, min_contexts)
    # What to remove depends on the text alone: equal texts share one entry.
    places = saved(
        texts.select("text_key", F.explode("spread").alias("line")).join(found, "line")
        .groupBy("text_key").agg(F.collect_list("line").alias("drop")), "places")
    names = [c for c in documents.columns if c not in (lines_col, removed_col)]
    joined = documents.select(
        F.struct(*names).alias("row"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("text_key"),
    ).join(places, "text_key", "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda line: (_bare(line) == "") | ~F.array_contains(
        F.col("drop"), F.md5(_bare(line))))
    n_lines = F.size(F.filter(lines, lambda line: _bare(line) != "")).cast("bigint")
    n_kept = F.size(F.filter(kept, lambda line: _bare(line) != "")).cast("bigint")
    changed = F.col("drop").isNotNull()
    done = joined.select(
        "row", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("new_text"),
        n_lines.alias("n_all"),
        F.when(changed, n_lines - n_kept).otherwise(F.lit(0)).cast("bigint").alias("n_gone"))
    return done.select(
        *[(F.col("new_text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names],
        F.col("n_all").alias(lines_col), F.col("n_gone").alias(removed_col))


ORACLE_SQL = f"""
with parts as (
  select doc_id, text, source, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
keyed as (select *, trim(line, ' ' || chr(9) || chr(13)) as bare from parts),
held as materialized (select distinct text, source, md5(bare) as h from keyed where bare <> ''),
spread as (select h from held group by h having count(distinct coalesce('=' || source, '')) >= {MIN_SITES}),
in_text as (select distinct text, h, h in (select h from spread) as is_spread from held),
texts as materialized (
  select text, count(*) as n, list_sort(list(h) filter (is_spread)) as s
  from in_text group by text having bool_or(is_spread)),
own as (
  select k.text, regexp_extract_all(k.bare, '[^ \\t\\r]+') as w from (select distinct text, bare from keyed) k
  join in_text i on k.bare <> '' and i.text = k.text and i.h = md5(k.bare) and not i.is_spread),
pairs as (
  select text, md5(array_to_string(w[i:i + 1], ' ')) as pair
  from (select text, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as i from own)),
least as (
  select text, {", ".join(f"min(substr(pair, {at}, 16)) as c{at}" for at in HASHES)} from pairs group by text),
contexts as (
  select text, h, {", ".join(
    f"case when 9 * len(s) >= 8 * n then 's' || s[1] || s[-1] else c{at} end as c{at}" for at in HASHES)}
  from (select *, unnest(s) as h from texts) left join least using (text)),
bad as (select h from contexts group by h
        having greatest({", ".join(f"count(distinct c{at})" for at in HASHES)}) >= {MIN_CONTEXTS}
        and 2 * greatest({", ".join(f"count(distinct c{at})" for at in HASHES)}) >= count(*)),
marked as (select k.*, b.h is not null as dropped from keyed k
           left join bad b on k.bare <> '' and md5(k.bare) = b.h),
done as (
  select doc_id, text, count(*) filter (bare <> '') as n_lines,
         count(*) filter (dropped) as n_removed,
         string_agg(line, chr(10) order by pos) filter (not dropped) as kept
  from (select distinct on (doc_id, text, pos) * from marked) group by doc_id, text)
select d.doc_id, coalesce(n.n_lines, 0) as n_lines, coalesce(n.n_removed, 0) as n_removed,
       case when d.text is null then null else coalesce(n.kept, '') end as text
from documents d left join done n on d.doc_id = n.doc_id and d.text = n.text
"""

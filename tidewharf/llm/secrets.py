"""Secret scans: candidates by pattern, told apart by who owns them across the corpus.

A candidate is a match of one of the patterns below; its value is known by its MD5 only. Over
the whole corpus every value gets the numbers of its occurrences, of the distinct repositories
and of the distinct owners that hold it. A value that several owners hold was copied from
a manual or a template (``example``); one that does not look random is a ``placeholder``;
one that a single owner holds is ``live``; what two owners share is ``shared``.

Everything is Spark SQL functions. Positions come from the pieces between the matches:
``split`` cuts where ``regexp_extract_all`` matches, and running sums over the lengths of both
give the offsets. The running sum goes by blocks of the square root of the number of matches,
so a text of many matches costs that number to the power of 1.5.

Ownership is counted by two groupings with partial sums: by value and owner, then by value.
Every value's rows fall in slices by the hash of their row, and its verdict is joined to each
slice, so that a value that a third of all documents hold is as many small groups. Only
positions, kinds and MD5s are stored and shuffled, never texts.

Defined results: a null or empty text has no spans; texts of any length are searched whole;
repeated rows are rows of their own, each with its result, and count as occurrences but not as
further owners; a null owner or repository is one of its own; ties in position go by the order
of ``KINDS``; all columns of the caller but the text stay, one that clashes with a new one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewharf.llm.common import let, saved

# The base patterns and the least lengths of what they find.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Owners from which on a value is an example, and pieces that the rows of a value fall in.
EXAMPLE_OWNERS = 3
SLICES = 64

PLACEHOLDER = (r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee]|[Dd][Uu][Mm][Mm][Yy]"
               r"|[Yy][Oo][Uu][Rr]|[Xx][Xx][Xx]|12345|00000")


def _either_case(words: tuple[str, ...]) -> str:
    """An alternation of the words in ASCII letters of either case."""
    return "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in words)


# Name, pattern, group of the value, least length of the value. A least length that is part of
# the pattern gives the same matches: those three patterns take whole stretches of their letters.
KINDS = (
    ("assign", f"(?:{_either_case(KEYWORDS)})"
     r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, MIN_ASSIGNED),
    ("access", rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 0, 0),
    ("hex", rf"[0-9a-f]{{{MIN_HEX},}}", 0, 0),
    # Added by this operator: tokens with a provider's prefix, signed web tokens, private keys
    # and passwords inside addresses.
    ("provider", r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
     r"|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----",
     0, 0),
    ("url", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:([^\x00-\x20/@]{1,128})@", 1, 0),
)
BASE_KINDS = 3
# What a text must hold for the pattern to match, where that is quick to look for.
NEEDED = {"access": ("AKIA",), "jwt": (".eyJ",), "pem": ("PRIVATE KEY-----",), "url": ("://",),
          "provider": ("gh", "glpat-", "xox", "sk_live_", "AIza", "npm_")}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x)


def _running_totals(values: Column) -> Column:
    """The sums of the first 1, 2, ... of an array of bigint that is not empty."""
    def blocks(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(all_), width),
                           lambda first: F.slice(all_, first, width))

    def summed(cut: Column) -> Column:
        return let(F.transform(cut, _total), lambda sums: let(
            F.transform(sums, lambda _, b: _total(F.slice(sums, 1, b))),
            lambda offsets: F.flatten(F.transform(cut, lambda block, b: F.transform(
                block, lambda _, i: F.get(offsets, b) + _total(F.slice(block, 1, i + 1)))))))

    return let(values, lambda all_: let(blocks(all_), summed))


def _length(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def _looks_live(value: Column) -> Column:
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
            & (F.size(F.array_distinct(F.split(value, ""))) >= 6))


def _spans(text: Column, number: int) -> Column:
    """start, kind number, end, MD5 of the value and whether it looks random, for one kind."""
    kind, pattern, group, least = KINDS[number]
    regex = F.lit(pattern)

    def placed(whole: Column) -> Column:
        values = whole if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
        # One piece more than matches; zip_with would take null for the last one's match.
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        ends = _running_totals(F.zip_with(pieces, whole, lambda p, w: _length(p) + _length(w)))
        parts = F.arrays_zip(ends.alias("end"), whole.alias("whole"), values.alias("value"))
        good = F.filter(parts, lambda m: F.char_length(m["value"]) >= least)
        return F.transform(good, lambda m: F.struct(
            (m["end"] - _length(m["whole"])).alias("start"), F.lit(number).alias("kind"),
            m["end"].alias("end"), F.md5(m["value"]).alias("value"),
            _looks_live(m["value"]).alias("looks_live")))

    found = let(F.regexp_extract_all(text, regex, F.lit(0)),
                 lambda whole: F.when(F.size(whole) > 0, placed(whole)))
    if kind in NEEDED:
        needed = F.lit(False)
        for word in NEEDED[kind]:
            needed |= F.contains(text, F.lit(word))
        found = F.when(needed, found)
    return F.coalesce(found, F.array().cast(
        "array<struct<start:bigint,kind:int,end:bigint,value:string,looks_live:boolean>>"))


def with_spans(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by ``spans``, its candidates by start and kind; offsets in code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        *[c for c in documents.columns if c not in (text_col, "spans")],
        F.array_sort(F.concat(*[_spans(text, i) for i in range(len(KINDS))])).alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``value, n_occurrences, n_repositories, n_owners, verdict`` of every value.

    ``candidates`` has a row per occurrence: ``value, owner, repository, looks_live``.
    """
    per_repository = candidates.groupBy("value", "owner", "repository").agg(
        F.count("*").alias("n"), F.bool_and("looks_live").alias("looks_live"))
    per_owner = per_repository.groupBy("value", "owner").agg(
        F.sum("n").alias("n"), F.count("*").alias("repositories"),
        F.bool_and("looks_live").alias("looks_live"))
    return per_owner.groupBy("value").agg(
        F.sum("n").alias("n_occurrences"), F.sum("repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"), F.bool_and("looks_live").alias("looks_live"),
    ).withColumn(
        "verdict",
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example")
        .when(~F.col("looks_live"), "placeholder")
        .when(F.col("n_owners") == 1, "live").otherwise("shared")).drop("looks_live")


def scan(
    documents: DataFrame, owner: Column, repository: Column, text_col: str = "text",
) -> DataFrame:
    """Every document without its text, with ``spans`` and the verdict on each.

    A span is ``start, kind, end, value, looks_live, n_occurrences, n_repositories, n_owners, verdict``.
    """
    kept = documents.select(
        F.struct(*[c for c in documents.columns if c not in (text_col, "spans")]).alias("row"),
        owner.alias("owner"), repository.alias("repository"), F.col(text_col).alias("text"))
    # The numbers of the rows are written once, so every later step sees the same.
    found = saved(with_spans(kept).withColumn("number", F.monotonically_increasing_id()), "secrets")
    candidates = found.select(
        "number", "owner", "repository", F.posexplode("spans").alias("at", "span"),
        F.pmod(F.xxhash64("number"), F.lit(SLICES)).alias("slice"),
    ).select("number", "at", "slice", "owner", "repository", "span.value", "span.looks_live")
    verdicts = saved(ownership(candidates), "verdicts")
    per_slice = candidates.select("value", "slice").distinct().join(verdicts, "value")
    judged = candidates.select("number", "at", "value", "slice").join(
        per_slice, ["value", "slice"]).groupBy("number").agg(F.array_sort(F.collect_list(F.struct(
            "at", "n_occurrences", "n_repositories", "n_owners", "verdict"))).alias("judged"))
    return found.join(judged, "number", "left").select("row.*", F.when(
        F.col("judged").isNull(), F.array()).otherwise(F.zip_with("spans", "judged", lambda s, j: F.struct(
            *[s[k].alias(k) for k in ("start", "kind", "end", "value", "looks_live")],
            *[j[k].alias(k) for k in ("n_occurrences", "n_repositories", "n_owners", "verdict")],
        ))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*[F.lit(kind[0]) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _oracle() -> str:
    quoted = [(n, p.replace("'", "''"), g, least) for n, p, g, least in KINDS]
    found = "\nUNION ALL\n".join(
        f"SELECT row, source, repository, {i} AS kind, list_zip("
        f"regexp_extract_all(t, '{p}', 0), regexp_extract_all(t, '{p}', {g}), "
        f"regexp_split_to_array(t, '{p}')) AS ms, {least} AS least FROM docs WHERE regexp_matches(t, '{p}')"
        for i, (_, p, g, least) in enumerate(quoted))
    names = "[" + ", ".join(f"'{n}'" for n, *_ in quoted) + "]"

    def listed_sql(condition: str) -> str:
        return (f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' "
                f"ORDER BY start, kind) FILTER (WHERE {condition}), '')")

    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t,
         concat_ws('/', coalesce(source, '-'), coalesce(lang, '-')) AS repository
  FROM documents),
matched AS MATERIALIZED ({found}),
placed AS (
  SELECT row, source, repository, kind, least, unnest(list_transform(
    list_filter(ms, lambda m: m[1] IS NOT NULL), lambda m, i: {{'whole': m[1], 'value': m[2],
    'stop': list_sum(list_transform(ms[1:i], lambda x: length(x[3]) + length(x[1])))}})) AS m
  FROM matched),
spans AS MATERIALIZED (
  SELECT row, source, repository, kind, m.stop::BIGINT - length(m.whole) AS start,
         m.stop::BIGINT AS stop, md5(m.value) AS value,
         regexp_matches(m.value, '[0-9]') AND regexp_matches(m.value, '[A-Za-z]')
         AND NOT regexp_matches(m.value, '{PLACEHOLDER}')
         AND len(list_distinct(string_split(m.value, ''))) >= 6 AS looks_live
  FROM placed WHERE length(m.value) >= least),
owners AS (
  SELECT value, count(DISTINCT coalesce('o' || source, '')) AS n_owners, bool_and(looks_live) AS looks_live
  FROM spans GROUP BY value),
judged AS (
  SELECT s.*, CASE WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN NOT o.looks_live THEN 'placeholder'
    WHEN n_owners = 1 THEN 'live' ELSE 'shared' END AS verdict
  FROM spans s JOIN owners o USING (value)),
per_row AS (
  SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex, {listed_sql(f"kind < {BASE_KINDS}")} AS base,
    {listed_sql("true")} AS spans, count(*) FILTER (WHERE verdict = 'live') AS n_live,
    count(*) FILTER (WHERE verdict = 'example') AS n_example, {listed_sql("verdict = 'live'")} AS live_spans
  FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live_spans, '') AS live_spans
FROM docs LEFT JOIN per_row USING (row)"""


ORACLE_SQL = _oracle()

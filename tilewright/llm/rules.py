"""Quality rules in DataFrame functions only: measures of each text, and the frequency of lines across documents of a host.

A text's own measures need no shuffle. A line is hashed in normal form (ASCII lower case, single blanks), and the distinct
documents that hold it are counted per host. Lines that reach the limit, a number of documents whatever the host's size, are
taken out, and a document that keeps too little of itself is rejected. Documents with the same text at one host are one
document for these counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import LOWER, SPACE_RUN, SPACES, UPPER, fresh, only

SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null reads as the empty text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def lines_of(text: Column) -> Column:
    """Lines with a word, as they are."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")


def repeated_words(words: Column, n: int = 8) -> Column:
    """Number of words that lie in a window of ``n`` words which is found at least twice."""

    def windows(hashes: Column) -> Column:
        starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - (n - 1)))
        return F.coalesce(
            F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, n))), F.array().cast("array<bigint>")
        )

    def covered(starts: Column) -> Column:
        steps = F.zip_with(
            starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.coalesce(b - a, F.lit(n))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + F.least(x, F.lit(n)))

    def found(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        pairs = _let(
            placed,
            lambda s: F.zip_with(
                s,
                F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(
                    F.array().cast("array<int>")
                ),
            ),
        )
        return _let(F.array_sort(F.array_distinct(F.flatten(pairs))), covered)

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return _let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found(h)),
    )


def measures(df: DataFrame, text: str, min_words: int, most_repeated: int) -> DataFrame:
    """``df`` with the measures of each text. Needs no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_words": words_of(F.col(text)), "_lines": lines_of(F.col(text))})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    return out.drop("_words", "_lines").withColumn("base_failed", base_failed(min_words, most_repeated))


def base_failed(min_words: int, most_repeated: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _same_text(text: str) -> Column:
    """Key of equal texts: a digest of 128 bits and the length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"), F.length(t).alias("c"))


def line_counts(df: DataFrame, host: str, text: str) -> DataFrame:
    """(host, doc, line, n_words): the lines of each distinct text of a host, with the words that they hold in all its
    copies."""
    raw = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("raw")
    words = df.select(F.col(host).alias("host"), _same_text(text).alias("doc"), raw).select("host", "doc", normal_words(F.col("raw")).alias("words"))
    one = words.select("host", "doc", normal_line(F.col("words")).alias("line"), F.size("words").alias("n")).where("n > 0")
    return one.groupBy("host", "doc", "line").agg(F.sum("n").alias("n_words"))


def normal_words(line: Column) -> Column:
    """Words of a line in ASCII lower case: one pass over its characters and a plain split, no regular expression per line."""
    blanks = "\t\x0b\x0c\r"
    return F.array_remove(F.split(F.translate(line, UPPER + blanks, LOWER + " " * len(blanks)), " "), "")


def normal_line(words: Column) -> Column:
    """Hash of a line in normal form, from its words."""
    return F.xxhash64(F.array_join(words, " "))


def without_lines(text: Column, hashes: Column) -> Column:
    """``text`` without the lines of these hashes; without hashes, the text as it is."""
    rest = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(hashes, normal_line(normal_words(x))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(rest, "\n"))


def line_verdicts(df: DataFrame, host: str, text: str, min_docs: int, least_left: float, min_words: int) -> DataFrame:
    """(d_host, d_doc, frequent, depleted) of the texts with frequent lines: the hashes of these lines, and whether without
    them fewer than ``min_words`` words are left that are less than ``least_left`` of all."""
    lines = fresh(line_counts(df, host, text), "lines")
    same_host = lambda a, b: a.eqNullSafe(b)  # noqa: E731  rows without a host are a host of their own
    frequent = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= min_docs)
    frequent = fresh(frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line")), "frequent")
    marked = lines.join(frequent, same_host(F.col("host"), F.col("f_host")) & (F.col("line") == F.col("f_line")))
    lost = marked.groupBy(F.col("host").alias("d_host"), F.col("doc").alias("d_doc")).agg(
        F.sum("n_words").alias("lost"), F.collect_list("line").alias("frequent")
    )
    all_words = lines.groupBy("host", "doc").agg(F.sum("n_words").alias("all"))
    left = F.col("all") - F.col("lost")
    return lost.join(all_words, same_host(F.col("d_host"), F.col("host")) & (F.col("d_doc") == F.col("doc"))).select(
        "d_host", "d_doc", "frequent", ((left < min_words) & (left < least_left * F.col("all"))).alias("depleted")
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_words: int = 20, most_repeated: int = 30, min_docs: int = 10, least_left: float = 0.5) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, ``n_removed_lines``, and ``text`` without the frequent lines of its host.

    A text fails by itself with fewer than ``min_words`` words or with over ``most_repeated`` percent of them in repeated
    windows. A line is frequent at a host if at least ``min_docs`` distinct documents of it hold it; a text is depleted and
    rejected if without frequent lines it has fewer than ``min_words`` words and less than ``least_left`` of its own. The
    measures are those of the whole text. A null text has no words, fails and stays null; rows without a host are one
    host; repeated rows have the same verdict and count once; null ids stay null; an empty table gives no rows; other
    columns are not carried.
    """
    docs = only(df, doc_id=id_col, text=text_col, host=host_col)
    found = line_verdicts(docs, "host", "text", min_docs, least_left, min_words)
    own = measures(docs.withColumn("doc", _same_text("text")), "text", min_words, most_repeated)
    out = own.join(found, own["host"].eqNullSafe(found["d_host"]) & (own["doc"] == found["d_doc"]), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    out = out.withColumn("rest", without_lines(F.col("text"), F.col("frequent")))
    removed = F.when(F.col("frequent").isNull(), 0).otherwise(F.size(lines_of(F.col("text"))) - F.size(lines_of(F.col("rest"))))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        removed.cast("long").alias("n_removed_lines"), F.col("rest").alias("text"),
    )


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 20,
              most_repeated: int = 30, min_docs: int = 10, least_left: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with all their columns; the text goes without its frequent lines, and
    ``n_chars``, where it is a column, follows."""
    docs = df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    found = line_verdicts(docs, "host", "text", min_docs, least_left, min_words)
    words = words_of(F.col("text"))
    good = docs.withColumn("_words", words).withColumns(
        {"n_words": F.size("_words"), "n_repeat_words": repeated_words(F.col("_words"))}
    )
    good = good.where(~base_failed(min_words, most_repeated)).select("row", "host", _same_text("text").alias("doc"))
    good = good.join(found, good["host"].eqNullSafe(found["d_host"]) & (good["doc"] == found["d_doc"]), "left")
    good = good.where(~F.coalesce("depleted", F.lit(False)))
    good = good.withColumn("rest", without_lines(F.col(f"row.`{text_col}`"), F.col("frequent")))
    new = {text_col: F.col("rest")}
    if "n_chars" in df.columns:
        chars = F.length("rest").cast(df.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("frequent").isNull(), F.col("row.n_chars")).otherwise(chars)
    return good.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns])


#: The same over the table ``documents``, with the default limits.
RULES_SQL = r"""
with docs as (
  select row_number() over () as row_id, doc_id, source, coalesce(text, '') as text, text is null as missing from documents),
split as (
  select row_id, doc_id, source, text, missing,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '') as lines
  from docs),
windows as (
  select row_id, i, array_to_string(words[i:i+7], ' ') as w
  from (select row_id, words, unnest(range(1, len(words) - 6)) as i from split)),
twice as (select row_id, i from windows qualify count(*) over (partition by row_id, w) > 1),
repeated as (
  select row_id, count(distinct p) as n from (select row_id, unnest(range(i, i + 8)) as p from twice) group by row_id),
texts as (select distinct source, text, lines from split),
each_line as (
  select source, text, length(regexp_replace(inner_, '[^ ]+', '', 'g')) + 1 as n, translate(inner_,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from (select source, text, trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as inner_
        from (select source, text, unnest(lines) as l from texts))),
frequent as (
  select source, line from each_line group by source, line having count(distinct text) >= 10),
depleted as (
  select e.source, e.text from each_line e left join frequent f
    on e.source is not distinct from f.source and e.line = f.line
  group by e.source, e.text
  having sum(case when f.line is null then n else 0 end) < least(20, 0.5 * sum(n)) and count(f.line) > 0),
placed as (
  select source, text, i, l, translate(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from (select source, text, unnest(string_split(text, chr(10))) as l,
          generate_subscripts(string_split(text, chr(10)), 1) as i from texts)),
rest as (
  select p.source, p.text, coalesce(string_agg(l, chr(10) order by i) filter (f.line is null), '') as rest,
    count(f.line) as n_removed
  from placed p left join frequent f on p.source is not distinct from f.source and p.line = f.line
  group by p.source, p.text),
measured as (
  select s.row_id, s.doc_id, s.source, s.text, s.missing, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    (length(s.text) - length(translate(s.text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from split s left join repeated r using (row_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and d.text is null as kept,
  t.n_removed as n_removed_lines, case when not missing then md5(rest) end as left_md5
from measured m left join depleted d on m.source is not distinct from d.source and m.text = d.text
  join rest t on m.source is not distinct from t.source and m.text = t.text
"""

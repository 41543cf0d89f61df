"""Grouping of spelling variants by asymmetric q-chunks (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of the
other. Of two near words the one that is not longer is cut into two disjoint chunks, its
halves. One edit touches one of them; the other is, as it is, a positional gram of the
second word, at the same place or, behind an inserted code point, one further. So each word
sends its two chunks, and its grams of the chunk sizes of words as long as itself and one
shorter from the places that such a shift allows; chunks and grams meet by an equality
join on length, chunk number and text, and what meets is verified.

Words that meet have a chunk in common, so what is left of them (half of each) differs by
one edit too. Where too many words meet at one chunk for a task, what is left is cut into
chunks in the same way, under the old key and the new one, until groups are small; at two
code points left a group can't be large. No pair is lost and no group is paired out: in
a task words meet through what stays when a code point is taken out, which only near
words share.

Defined results: null text has no words; of a row without doc_id no run is changed; each
row counts, repeated ones too; words of any length are treated alike; ties go to the
smaller word in code-point order; an empty table gives no rows. Only doc_id and text are
read, so other columns can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import map_rows, table, text_or_empty, written

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is this many times as frequent as the word.
TIMES = 10
#: Most words of a group, and most bytes of what is compared in one; beyond, chunks are cut again.
GROUP, BYTES = 256, 1 << 22
#: Groups of at most so many words are compared one with another.
FEW = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def altered(run: Column, doc_id: Column) -> Column:
    """``run`` without one code point where 31 divides the checksum of its document and itself."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(h % 31 == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change=altered) -> DataFrame:
    """(word, n) of the words of ``docs``; ``change`` may alter a run (run, doc_id) of letters first."""
    # A run below the least length can't become longer; the pattern takes whole runs only.
    found = F.regexp_extract_all(text_or_empty(), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("_run")).select("doc_id", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    words = runs.select((F.col("_run") if change is None else change(F.col("_run"), F.col("doc_id"))).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def chunks(rows: DataFrame) -> DataFrame:
    """(word, rest, key, longer) for (word, rest, key): two chunks and the grams that can meet another word's chunks.

    ``rest`` is what is left beside the chunk or gram; ``longer`` rows are grams that meet chunks of words one shorter.
    """
    size = F.char_length("rest")

    def part(shorter: int, number: int) -> Column:
        """Chunk ``number`` of a word of this size, or the gram that is chunk ``number`` of a word one shorter."""
        q = F.floor((size - shorter) / 2).cast("int")
        cut = q + shorter if number else q  # an inserted code point stays in the rest
        first, second = F.substring(F.col("rest"), F.lit(1), cut), F.substring(F.col("rest"), cut + 1, size)
        text, rest = (second, first) if number else (first, second)
        return F.struct(F.xxhash64("key", size - shorter, F.lit(number), text).alias("key"), rest.alias("rest"), F.lit(bool(shorter)).alias("longer"))

    made = F.explode(F.array(part(0, 0), part(0, 1), part(1, 0), part(1, 1))).alias("_p")
    return rows.select("word", made).select("word", "_p.*")


def is_near(a: str, b: str) -> bool:
    """Whether ``b``, which is not shorter, is ``a`` with exactly one edit."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(b) != len(a) + 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


def near_in_group(group: list[dict]) -> Iterator[tuple[str, str]]:
    """The near pairs of one group of chunks and grams, of which at least one is a chunk."""
    own = [(g["word"], g["rest"]) for g in group if not g["longer"]]
    longer = [(g["word"], g["rest"]) for g in group if g["longer"]]
    if len(group) <= FEW:
        for i, (a, r) in enumerate(own):
            yield from ((a, b) for b, s in own[:i] if is_near(r, s) and is_near(a, b))
            yield from ((a, b) for b, s in longer if is_near(r, s) and is_near(a, b))
        return
    whole, without = defaultdict(list), defaultdict(list)
    for a, r in own:
        whole[r].append(a)
        for i in range(len(r)):
            without[i, r[:i] + r[i + 1 :]].append(a)
    for same in without.values():
        for i, a in enumerate(same):
            yield from ((a, b) for b in same[:i] if is_near(a, b))
    for b, s in longer:
        for shorter in {s[:i] + s[i + 1 :] for i in range(len(s))}:
            yield from ((a, b) for a in whole.get(shorter, ()) if is_near(a, b))


def _pairs(batch: pa.RecordBatch) -> dict | None:
    found = [(min(a, b), max(a, b)) for group in batch.column("_all").to_pylist() for a, b in near_in_group(group)]
    return {"a": pa.array([a for a, _ in found]), "b": pa.array([b for _, b in found])} if found else None


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) with a < b: all near pairs of ``words`` (a written table with distinct ``word``)."""
    todo = words.select("word", F.col("word").alias("rest"), F.lit(0).cast("long").alias("key"))
    found = None
    while True:
        rows = written(chunks(todo))
        length = F.char_length("rest").cast("long")
        sizes = rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("_n"), F.sum((~F.col("longer")).cast("int")).alias("_own"), F.max(length).alias("_most"), F.sum(length * length).alias("_bytes")
        )
        small = (F.col("_n") <= FEW) | (F.col("_n") <= group) & (F.col("_bytes") <= BYTES) | (F.col("_most") <= 2)
        # Counted tables are written before they are joined: a join of two plain shuffles can split a hot key.
        sizes = written(sizes.where("_n > 1 AND _own > 0").select("key", (~small).alias("_hot")))
        met = rows.join(sizes, "key")
        gathered = met.where("NOT _hot").groupBy("key").agg(F.collect_list(F.struct("word", "rest", "longer")).alias("_all"))
        pairs = written(map_rows(gathered.select("_all"), "a string, b string", _pairs, rows=500))
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where("_hot").isEmpty():
            return found.distinct()
        # A word may be in a group as a chunk and, by a gram of another size, in another; both go on.
        todo = met.where("_hot").select("word", "rest", "key").distinct()


def variants(words: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n)."""
    words = written(words)
    pairs = written(near_pairs(words, group))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_other")).union(pairs.select("b", "a"))
    counts = words.select(F.col("word").alias("_other"), F.col("n").alias("_n"))
    near = both.join(counts, "_other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("m"), F.col("_other").alias("w"))).alias("_best"))
    much = F.col("_best").isNotNull() & (-F.col("_best.m") >= times * F.col("n"))
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("_best.w")).alias("form"), F.when(much, -F.col("_best.m")).alias("form_n")
    )
    out = written(out)
    return out.join(_roots(out), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the part of the way that is known."""
    ways = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ways = written(ways.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more")))
        if ways.where("_more").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("_more")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: The same words by checksums in SQL, near words by deletion of code points, roots by recursion.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, times, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS b
  FROM distinct_runs),
hashed AS (
  SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM bytes, crc_table),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times
  FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN words w ON cut.v = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN words w ON cut.v = w.word),
ranked AS (
  SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS r
  FROM pairs p JOIN words o ON p.other = o.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked k ON w.word = k.word AND r = 1),
way AS (
  SELECT word, coalesce(form, word) AS reached, form IS NOT NULL AS more FROM forms
  UNION ALL SELECT way.word, f.form, true FROM way JOIN forms f ON way.reached = f.word WHERE way.more AND f.form IS NOT NULL),
roots AS (SELECT way.word, arg_max(reached, w.n) AS root FROM way JOIN words w ON way.reached = w.word GROUP BY way.word)
SELECT f.word, f.form, roots.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots USING (word)
"""

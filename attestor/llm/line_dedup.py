"""Near-duplicate lines by a deletion-neighbourhood join over words and over characters.

A line is dropped if an earlier line (smaller document id, then place) is equal to it or one edit
away. The edit is of one character in lines of at least ``min_chars`` characters (so such lines are
0.95 alike), or of one whole word in lines of at least ``min_words`` words (0.8 alike): one token
changed, inserted or left out. Blank lines, which part paragraphs, stay.

1. Equal lines meet by a hash of 128 bits; the first one stands for all.
2. If two lines are one edit apart, the edit leaves the first or the last half of the tokens as it
   was. Lines that share no half with a different line therefore have no partner and are set aside.
3. The others are cut into blocks of some few tokens. An edit lies in one block and leaves all before
   and behind it as it was: two lines one edit apart share the hash of that *frame*, and what the frame
   encloses is one edit apart.
4. Lines that share a frame emit their *variants* there: the enclosed tokens, and the enclosed tokens
   without each one of them, as hashed keys. Lines that share a variant are one edit apart if the
   deleted places agree (a change), or if one of the two, longer by one, deleted and the other did not
   (an insertion). Each line therefore needs the earliest line of its variant groups only, which is a
   combined minimum: no pairs within a group are made, however large.
5. That earliest line is compared token by token, which settles the edit distance.

Only DataFrame functions are used. Lines are told apart by (id, row, place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.bitset import bitset, only_possible, with_test
from attestor.llm.common import cut, numbered, prepare, unused

#: Least words of a line for an edit of a word, and least characters for an edit of a character.
MIN_WORDS, MIN_CHARS = 5, 20
_BY_WORD, _BY_CHAR = 0, 1
#: Blocks of a line, at least, and tokens of a block, at most.
BLOCKS, BLOCK_TOKENS = 16, 64
_LAST = (1 << 63) - 1
_AT = ["doc", "uid", "pos"]
_FRAME = ["kind", "base", "block", "frame"]


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that is not blank: doc, uid, pos, line, words (what single spaces part), chars."""
    lines = rows.select("doc", "uid", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^ \t\r]"))
    return lines.select(*_AT, "line", (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).alias("words"), F.length("line").alias("chars"))


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def _kinds(min_words: int, min_chars: int) -> dict:
    """By kind of edit: tokens of a line, the least that take part, and its first and last so many tokens."""
    line = F.col("line")
    return {
        _BY_WORD: (F.col("words"), min_words, lambda m: F.call_function("substring_index", line, F.lit(" "), m), lambda m: F.call_function("substring_index", line, F.lit(" "), -m)),
        _BY_CHAR: (F.col("chars"), min_chars, lambda m: F.left(line, m), lambda m: F.right(line, m)),
    }


def _halves(min_words: int, min_chars: int) -> Column:
    """Hashes of the first and last halves that an edit may leave whole (for partners of any length); some may be null."""
    out = []
    for kind, (n, least, first, last) in _kinds(min_words, min_chars).items():
        both = lambda m: (F.xxhash64(F.lit(2 * kind), m, first(m)), F.xxhash64(F.lit(2 * kind + 1), m, last(m)))  # noqa: E731, B023
        more, less = F.shiftright(n - 1, 1), F.shiftright(n - 2, 1)
        out += [F.when(n >= least, key) for key in both(more)] + [F.when((n >= least) & (more != less), key) for key in both(less)]
    return F.array(*out)


def _blocks(base: Column) -> Column:
    return F.greatest(F.lit(BLOCKS), F.ceil(base / BLOCK_TOKENS).cast("int"))


def _border(block: Column, base: Column) -> Column:
    return F.floor(block.cast("long") * base / _blocks(base)).cast("int")


def _frames(candidates: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """(doc, uid, pos, n, kind, base, block, frame): what surrounds each block, for partners of equal length or longer (base = n) and shorter ones (base = n - 1)."""
    out = None
    for kind, (n, least, first, last) in _kinds(min_words, min_chars).items():
        rows = candidates.where(n >= least).select(*_AT, "line", n.alias("n"), F.explode(F.array(n, n - 1)).alias("base"))
        base = F.col("base")
        around = lambda b: F.xxhash64(first(_border(b, base)), F.lit(kind), last(base - _border(b + 1, base)))  # noqa: E731, B023
        frames = F.transform(F.sequence(F.lit(0), _blocks(base) - 1), around)
        rows = rows.select(*_AT, "n", F.lit(kind).alias("kind"), "base", F.posexplode(frames).alias("block", "frame"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _variants(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, uid, pos, kind, base, block, frame, n, key, gone): the tokens that a frame encloses (gone = -1), and without token ``gone``."""
    b, base, n = F.col("block"), F.col("base"), F.col("n")
    low, high = _border(b, base), _border(b + 1, base) + n - base
    tokens = F.when(F.col("kind") == _BY_WORD, F.split("line", " ")).otherwise(F.split("line", ""))
    inner = frames.join(candidates.select("uid", "pos", "line"), ["uid", "pos"]).select(*_AT, *_FRAME, "n", F.slice(tokens, low + 1, high - low).alias("inner"))
    key = lambda x, k: F.struct(k.alias("gone"), F.xxhash64(F.concat(F.slice(x, 1, k), F.slice(x, k + 2, F.size(x)))).alias("key"))
    deleted = F.when(F.size("inner") > 0, F.transform(F.sequence(F.lit(0), F.size("inner") - 1), lambda k: key(F.col("inner"), k)))
    whole = F.when(n == base, F.array(F.struct(F.lit(-1).alias("gone"), F.xxhash64("inner").alias("key"))))  # a longer line deletes always
    none = F.array().cast("array<struct<gone:int,key:bigint>>")
    return inner.select(*_AT, *_FRAME, "n", F.inline(F.concat(F.coalesce(deleted, none), F.coalesce(whole, none))))


def _one_word_apart(a: str, b: str) -> Column:
    """Are two lines at most one word's edit apart?"""
    less = F.col(f"{a}.words") <= F.col(f"{b}.words")
    one, two = F.col(f"{a}.line"), F.col(f"{b}.line")
    pair = F.array(F.struct(F.split(F.when(less, one).otherwise(two), " ").alias("s"), F.split(F.when(less, two).otherwise(one), " ").alias("t")))

    def test(p: Column) -> Column:
        differ = F.zip_with(p["s"], F.slice(p["t"], 1, F.size(p["s"])), lambda x, y: x != y)
        i = F.array_position(differ, True)  # 0: the longer one goes on after the shorter
        i = F.when(i == 0, F.size(p["s"]) + 1).otherwise(i).cast("int")
        rest = F.size(p["t"])
        changed = F.slice(p["s"], i + 1, rest) == F.slice(p["t"], i + 1, rest)
        inserted = F.slice(p["s"], i, rest) == F.slice(p["t"], i + 1, rest)
        return F.when(F.size(p["s"]) == F.size(p["t"]), changed).otherwise((F.size(p["t"]) - F.size(p["s"]) == 1) & inserted)

    return F.transform(pair, test)[0]


def _one_edit(a: str, b: str) -> Column:
    """Are two lines at most one edit of the given kind apart?"""
    return F.when(F.col("kind") == _BY_WORD, _one_word_apart(a, b)).otherwise(F.levenshtein(F.col(f"{a}.line"), F.col(f"{b}.line"), 1) >= 0)


def _semi(rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Left semi join; rows without a partner are mostly left out before the shuffle."""
    key = F.xxhash64(*columns)
    return only_possible(rows, key, bitset(other, key)).join(other, list(columns), "left_semi")


def _near(rows: DataFrame, lines: DataFrame, later: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """(uid, pos) of the first copies of lines that have an earlier line one edit away."""
    keys = lines.select("h1", F.explode("halves").alias("half")).where("half IS NOT NULL")
    shared = cut(keys.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half"))
    chosen = cut(_semi(keys, shared, "half").select("h1").distinct())
    places = cut(_semi(lines.select("h1", "uid", "pos"), chosen, "h1").join(later, ["uid", "pos"], "left_anti").select("uid", "pos"))
    candidates = cut(_semi(_lines(rows), places, "uid", "pos"))

    frames = _frames(candidates, min_words, min_chars).checkpoint()
    one = F.xxhash64("uid", "pos")
    several = lambda rows, *by: rows.groupBy(*by).agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high").select(*by)
    frames = cut(frames.join(several(frames, *_FRAME), _FRAME))
    variants = cut(_variants(frames, candidates).withColumn("at", F.struct(*_AT)))
    changed, longer, whole = variants.where("n = base AND gone >= 0"), variants.where("n > base"), variants.where("gone < 0")
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min("at").alias("by"))
    key = [*_FRAME, "key"]
    links = [changed.join(first(changed, *key, "gone"), [*key, "gone"]), longer.join(first(whole, *key), key), whole.join(first(longer, *key), key)]
    links = links[0].select("kind", "at", "by").unionByName(links[1].select("kind", "at", "by")).unionByName(links[2].select("kind", "at", "by"))
    links = links.where("by < at").groupBy("kind", "at").agg(F.min("by").alias("by")).select("kind", "at.uid", "at.pos", F.col("by.uid").alias("by_uid"), F.col("by.pos").alias("by_pos"))
    a, b = candidates.select("uid", "pos", F.struct("words", "line").alias("a")), candidates.select(F.col("uid").alias("by_uid"), F.col("pos").alias("by_pos"), F.struct("words", "line").alias("b"))
    return links.join(a, ["uid", "pos"]).join(b, ["by_uid", "by_pos"]).where(_one_edit("a", "b")).select("uid", "pos").distinct()


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, row_column: str | None = None) -> DataFrame:
    """(uid, id, n_lines, n_removed, kept): every document without its repeated lines.

    ``kept`` is the text of the lines that stay, joined by newlines; a document that loses all lines
    keeps the empty text. A null text is the empty text (one empty line, which stays). Rows with the
    same id stand in the table's order; null ids come after all others. ``uid`` numbers the rows of
    docs (``row_column``, if the caller has numbered them). An empty table gives an empty result;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    if row_column is None:
        row_column = unused(docs, "__uid")
        docs = numbered(docs, row_column)
    rows = docs.select(F.col(row_column).alias("uid"), F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    lines = _hashed(_lines(rows)).select("h1", "h2", *_AT, _halves(min_words, min_chars).alias("halves")).checkpoint()
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct(*_AT)).alias("first"), F.count("*").alias("copies"))
    repeated = cut(distinct.where("copies > 1").select("h1", "h2", "first"))  # joined afresh, so that a hot line's rows can be split
    later = cut(lines.select("h1", "h2", "uid", "pos").join(repeated, ["h1", "h2"]).where((F.col("uid") != F.col("first.uid")) | (F.col("pos") != F.col("first.pos"))).select("uid", "pos"))
    near = _near(rows, lines, later, min_words, min_chars)
    dropped = cut(later.unionByName(near).groupBy("uid").agg(F.collect_list("pos").alias("gone")))  # no more than a document's lines
    tested = with_test(rows, F.xxhash64("uid"), bitset(dropped, F.xxhash64("uid")), "some").select("uid", "id", "text", "some")
    done = tested.where("some").join(dropped, "uid", "left").unionByName(tested.where("NOT some").withColumn("gone", F.lit(None).cast("array<int>"))).drop("some")
    parts = F.split("text", "\n")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    kept = F.transform(F.array(parts), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))[0]
    return done.select(
        "uid", F.col("id").alias(id_column), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def _edits(lines: str, whole: str, without: str) -> str:
    """SQL for the first copies that have an earlier line one edit away: all variants, joined as they are."""
    return f"""
    SELECT v.first FROM ({without}) v JOIN (SELECT rest, i, min(first) AS by FROM ({without}) GROUP BY rest, i) s ON v.rest = s.rest AND v.i = s.i WHERE s.by < v.first
    UNION SELECT v.first FROM ({without}) v JOIN {lines} ON v.rest = {whole} WHERE f.first < v.first
    UNION SELECT f.first FROM {lines} JOIN (SELECT rest, min(first) AS by FROM ({without}) GROUP BY rest) d ON d.rest = {whole} WHERE d.by < f.first"""


_WORDS_SQL = _edits(f"(SELECT * FROM f WHERE len(w) >= {MIN_WORDS}) f", "f.w", "SELECT * FROM by_word")
_CHARS_SQL = _edits(f"(SELECT * FROM f WHERE length(line) >= {MIN_CHARS}) f", "md5_number(f.line)", "SELECT * FROM by_char")

#: DuckDB SQL for the query over drop_repeated_lines(): variants by words as lists, by characters as digests of the strings.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
),
f AS MATERIALIZED (
  SELECT line, string_split(line, ' ') AS w, min((doc_id, pos)) AS first
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY line
),
by_word AS MATERIALIZED (SELECT first, i, w[1:i - 1] || w[i + 1:] AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {MIN_WORDS})),
by_char AS MATERIALIZED (SELECT first, i, md5_number(left(line, i - 1) || substr(line, i + 1)) AS rest FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM f WHERE length(line) >= {MIN_CHARS})),
e AS ({_WORDS_SQL}
    UNION {_CHARS_SQL}),
g AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND ((l.doc_id, l.pos) <> f.first OR e.first IS NOT NULL) AS gone
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN e ON e.first = f.first
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""

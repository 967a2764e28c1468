"""Quality rules: a table of thresholds compiled into one projection over the text, without user functions.

Words are runs of characters other than blanks, tabs and line ends. Null and empty texts have no
words and fail the base rules. Lines that repeat are judged by their characters' share, so a heading
or footer that comes back rejects no text. Rows are judged one by one, so ties, repeated rows and empty tables
need no care; of extra columns only the id and the text are read. Memory for one text is a small
multiple of its length: windows of words are kept as 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent words of the corpus' four languages, as they stand in a text.
STOP_WORDS = {
    "en": "the of and to in a is that for it with as was on be by this are or an at from",
    "de": "der die das und in zu den mit von ist des im ein eine dem nicht auf für sich er",
    "fr": "de la le les et un une du en que est dans qui par pour des au sur pas il elle",
    "es": "de la el los las en y que por con una un se no del al lo es para su",
}


@dataclass(frozen=True)
class Rule:
    """Keeps a text if low * per <= 100 * measure <= high * per; None sets no bound."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None

    def column(self) -> Column:
        c = F.lit(True)
        if self.low is not None:
            c = c & (100 * F.col(self.measure) >= self.low * F.col(self.per))
        if self.high is not None:
            c = c & (100 * F.col(self.measure) <= self.high * F.col(self.per))
        return c

    def sql(self) -> str:
        tests = [f"100 * {self.measure} >= {self.low} * {self.per}" if self.low is not None else "", f"100 * {self.measure} <= {self.high} * {self.per}" if self.high is not None else ""]
        return " AND ".join(t for t in tests if t) or "true"


#: Percentages of words, of the characters in lines with a word, or of 1.
RULES = (
    Rule("long_enough", "n_words", "one", low=2000),
    Rule("short_enough", "n_words", "one", high=100 * 10**9),
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "dup_line_chars", "line_chars", high=30),
)


def stop_words() -> list[str]:
    lower = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    return lower + [w[0].upper() + w[1:] for w in lower]


def _let(value: Column, body) -> Column:
    """body(v) with value computed once, however often body uses v."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def total(at: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(at, begin, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total(_let(pairs, starts)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules compare; row holds the document as it came."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), F.struct("*").alias("row"))
    words = _let(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: F.filter(w, lambda x: x != ""))
    # Without the separators a text is its words.
    bare = F.length(F.translate("text", SEPARATORS, ""))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def repeats(w: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(h, i + 1, WINDOW)))
            return _let(windows, lambda v: _covered(v, WINDOW))

        return F.struct(F.size(w).cast("long").alias("n_words"), _let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("n_repeat_words"), F.size(F.filter(w, lambda x: x.isin(stop_words()))).cast("long").alias("n_stop_words"))

    chars = lambda x: F.length(F.array_join(x, "")).cast("long")

    def of_lines(x: Column) -> Column:
        return _let(F.array_distinct(x), lambda once: F.struct((F.size(x) - F.size(once)).cast("long").alias("n_dup_lines"), chars(x).alias("line_chars"), (chars(x) - chars(once)).alias("dup_line_chars")))

    line_counts = _let(lines, of_lines)
    rows = rows.select("doc_id", "row", _let(words, repeats).alias("w"), bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), line_counts.alias("l"))
    return rows.select("doc_id", "row", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_stop_words", "l.line_chars", "l.dup_line_chars", F.lit(1).cast("long").alias("one"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """One row for each document: its counts, base_failed, kept, and the rules that failed; with_row
    adds the document itself as row."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(~r.column(), F.lit(r.name)) for r in rules)))
    rows = measures(docs, id_col, text_col)
    kept = ~base
    for r in rules:
        kept = kept & r.column()
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"), F.concat_ws(",", failed).alias("failed_rules"), *(["row"] if with_row else []))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns, in one pass over them."""
    return judge(docs, rules, with_row=True).where("kept").select("row.*")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result for the documents table in DuckDB's SQL."""
    stops = ", ".join("'" + w + "'" for w in stop_words())
    failed = ", ".join(f"CASE WHEN NOT ({r.sql()}) THEN '{r.name}' END" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+{WINDOW - 1}], ' ')) AS n FROM win),
c AS (SELECT doc_id, least({WINDOW}, i - lag(i, 1, i - {WINDOW}) OVER (PARTITION BY doc_id ORDER BY i)) AS k FROM g WHERE n > 1),
r AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, length(array_to_string(ls, ''))::BIGINT AS line_chars,
  (length(array_to_string(ls, '')) - length(array_to_string(list_distinct(ls), '')))::BIGINT AS dup_line_chars,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words, 1::BIGINT AS one FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"({r.sql()})" for r in rules)} AS kept, concat_ws(',', {failed}) AS failed_rules FROM v"""

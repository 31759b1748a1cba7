"""URL filters: host and path rules, then naive Bayes over segmented names.

1. Words of all pages' texts, counted in Spark, are a unigram model. Each
   distinct name of a host or path is joined, by its parts, to the counts of
   the words it may consist of, and a Viterbi search splits it into the most
   probable ones.
2. Multinomial naive Bayes over the words of all urls judges those that no rule
   fits. A lexicon labels urls, but no word is ever labelled by itself: a first
   model leaves the lexicon out of its features, and in the second every word
   of a url is counted under what the other words of that url say.

Tables of words, names and odds stay in Spark and are joined, whatever their
size; hot names and tokens are dealt out by a salt, and the shortest words,
which are parts of most names, are few enough to be broadcast. Only a few sums
reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches
from lumicurve.session import materialise

# Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words whose presence marks a url as unwanted for learning.
UNWANTED_WORDS = frozenset(
    "ad ads adult adults bet bets betting bingo casino casinos cialis dating escort escorts gambling hentai jackpot lottery nude nudes payday pharma "
    "pill pills poker porn porno replica roulette sex sexy slots spam track tracker tracking viagra warez webcam xxx".split()
)
# Further words that names are often joined from, so that they can be split before the pages use them.
COMMON_WORDS = frozenset(
    "best blog book buy cheap club daily deal deals download farm fast forum free game games girls hot live loan loans mail market money movie "
    "movies music news online page photo play prime shop site store stream super top video videos web win world".split()
)

#: In how many parts the rows of one name or token are joined.
SALTS = 16

#: Words of so few letters are broadcast: there are at most 26^2 + 26^3 of them.
SHORT = 3

#: Letters of the longest word: a host's label has at most 63 characters.
LONGEST = 63

_LOWER = {c: c + 32 for c in range(65, 91)}
_NAME_PARTS = re.compile("[a-z]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)
    host, slash, path = rest[0].partition("/")
    return host.translate(_LOWER), slash + path


def fitting_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """The longest rule (as host and path together) that fits, and its verdict."""
    fits = [(h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: (len(r[0]), r[0])) if fits else None


def split_name(name: str, found: Sequence[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable words of a name. ``found``: (start, length, count) of
    the parts that are words; ``total``: the sum of all words' counts.

    A stretch that is no word costs as much as letters drawn at random, so
    unknown names stay whole rather than fall to pieces. Of splits that cost the
    same, the one whose last word is longer wins, then that before it.
    """
    n, log_total = len(name), math.log(total + 1)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, count in found:
        ending[start + length].append((start, log_total - math.log(count)))
    # The cheapest ways to each place that end in a word, and in an unknown stretch; where each came from.
    word, loose = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    from_word, opened = [0] * (n + 1), [False] * (n + 1)
    for end in range(1, n + 1):
        for start, cost in sorted(ending[end]):
            way = min(word[start], loose[start]) + cost
            if way < word[end]:
                word[end], from_word[end] = way, start
        opened[end] = word[end - 1] + log_total < loose[end - 1]
        loose[end] = min(word[end - 1] + log_total, loose[end - 1]) + math.log(26)
    words, end, known = [], n, word[n] <= loose[n]
    while end:
        stop = end
        if known:
            end = from_word[end]
            known = word[end] <= loose[end]
        else:
            while not opened[end]:
                end -= 1
            end, known = end - 1, True
        words.append(name[end:stop])
    return words[::-1]


def names_of(host: str, path: str) -> list[tuple[str, bool]]:
    """Runs of letters in host and path, and whether they are of the path; the
    host's last label (its top-level domain) is left out."""
    names = host.rpartition(".")[0] if "." in host else host
    return [(x, False) for x in _NAME_PARTS.findall(names)] + [(x, True) for x in _NAME_PARTS.findall(path.translate(_LOWER))]


def word_counts(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """(word, n): counts of ASCII words of 2 to ``LONGEST`` letters over the
    texts of all pages; a fixed list of words that names are joined from counts
    as usual words even where the pages lack them."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"<(script|style)\b[^>]*>.*?</\1>|<[^>]*>|&[a-z]+;", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?<![a-z\x80-￿])[a-z]{{2,{LONGEST}}}(?![a-z\x80-￿])"), 0)).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-words")
    usual = max(10, (counts.agg(F.sum("n")).collect()[0][0] or 0) // 100_000)
    listed = pages.sparkSession.createDataFrame([(w, usual) for w in sorted(UNWANTED_WORDS | COMMON_WORDS)], "word string, n long")
    return counts.union(listed).groupBy("word").agg(F.max("n").alias("n"))


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of each distinct name. A name's parts that may be words are
    joined to the words; what comes together for a name is bounded by its own
    length, however often it stands in urls."""
    total = counts.agg(F.sum("n")).collect()[0][0] or 1
    names = names.select("name").distinct()
    starts = names.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("name") - 1)))
    lengths = F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("name") - F.col("start")))
    parts = starts.where(F.length("name") - F.col("start") >= 2).withColumn("length", F.explode(lengths))
    parts = parts.withColumn("word", F.substring("name", F.col("start") + 1, F.col("length")))
    is_short = F.length("word") <= SHORT
    found = parts.where(is_short).join(F.broadcast(counts.where(is_short)), "word").unionByName(parts.where(~is_short).join(counts.where(~is_short), "word"))
    found = found.groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("found"))

    def run(batches):
        for b in batches:
            words = [split_name(name, [(f["start"], f["length"], f["n"]) for f in found or ()], total) for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return in_batches(names.join(found, "name", "left"), ["name", "found"], run, "name string, words array<string>")


def salted(table: DataFrame) -> DataFrame:
    """The table once for each salt."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt_of(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")


def words_of_urls(parsed: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, tokens) of each row with names: words of the host, then those of
    the path with a slash in front."""
    names = parsed.select("row", F.posexplode("names").alias("at", "named")).select("row", "at", "named.name", "named.of_path", salt_of("row").alias("salt"))
    split = materialise(split_names(names, counts), "url-names")
    words = names.join(salted(split), ["name", "salt"]).withColumn("words", F.when(F.col("of_path"), F.transform("words", lambda w: F.concat(F.lit("/"), w))).otherwise(F.col("words")))
    return words.groupBy("row").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "words")))["words"]).alias("tokens"))


@dataclass
class NaiveBayes:
    """Log odds of unwanted against wanted: the prior's, and each token's in a table (token, odds)."""

    prior: float
    odds: DataFrame


def bare(token: Column | str) -> Column:
    """A token without the slash that marks the path's."""
    return F.ltrim(F.col(token) if isinstance(token, str) else token, F.lit("/"))


def fit(urls: DataFrame, tokens: DataFrame, smoothing: float) -> NaiveBayes:
    """Multinomial naive Bayes from (bad) of urls and (token, bad) of their tokens."""
    said = urls.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()[0]
    counts = materialise(tokens.groupBy("token").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")), "url-tokens")
    sums = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count(F.lit(1)).alias("tokens")).collect()[0]
    bad_total, good_total = (sums[c] + smoothing * (sums["tokens"] + 1) for c in ("bad", "good"))
    odds = counts.select("token", (F.log((F.col("bad") + smoothing) / bad_total) - F.log((F.col("good") + smoothing) / good_total)).alias("odds"))
    return NaiveBayes(math.log((said["bad"] + smoothing) / (said["good"] + smoothing)), odds)


def joined_odds(tokens: DataFrame, bayes: NaiveBayes) -> DataFrame:
    """(row, token) with the odds of each token, 0 for one that was never counted."""
    tokens = tokens.withColumn("salt", salt_of("row"))
    return tokens.join(salted(bayes.odds), ["token", "salt"], "left").drop("salt").withColumn("odds", F.coalesce("odds", F.lit(0.0)))


def scores(tokens: DataFrame, bayes: NaiveBayes) -> DataFrame:
    """(row, score) of each row of (row, token)."""
    return joined_odds(tokens, bayes).groupBy("row").agg((F.lit(bayes.prior) + F.sum("odds")).alias("score"))


def train_bayes(rows: DataFrame, smoothing: float = 0.5, lexicon: Sequence[str] = tuple(sorted(UNWANTED_WORDS))) -> tuple[NaiveBayes, NaiveBayes]:
    """The first and the final model from all urls (row, tokens).

    First: urls with a word of the lexicon are bad; the features are all other
    words. Final: a token is counted as bad in a url if another word there is in
    the lexicon or the first model, without that token, finds the url bad.
    """
    is_listed = bare("token").isin(*lexicon)
    tokens = rows.select("row", F.explode("tokens").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("m"))
    words = F.array_distinct(F.transform(F.filter("tokens", lambda t: bare(t).isin(*lexicon)), bare))
    hits = rows.select("row", words.alias("listed"))
    urls = hits.select("row", "listed", (F.size("listed") > 0).alias("bad"))
    first_tokens = rows.select(F.explode(F.filter("tokens", lambda t: ~bare(t).isin(*lexicon))).alias("token"), (F.size(words) > 0).alias("bad"))
    first = fit(urls, first_tokens, smoothing)
    own = joined_odds(tokens.where(~is_listed), first)
    sums = own.groupBy("row").agg(F.sum(F.col("m") * F.col("odds")).alias("sum"))
    known = materialise(hits.join(sums, "row", "left").select("row", "listed", (F.lit(first.prior) + F.coalesce("sum", F.lit(0.0))).alias("score")), "url-scores")
    each = own.select("row", "token", "m", "odds").union(tokens.where(is_listed).select("row", "token", "m", F.lit(0.0)))
    others = F.size(F.array_remove(F.col("listed"), bare("token"))) > 0
    labelled = each.join(known, "row").select("token", "m", (others | (F.col("score") - F.col("m") * F.col("odds") > 0)).alias("bad"))
    labelled = labelled.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("m")
    final = fit(known.select(((F.size("listed") > 0) | (F.col("score") > 0)).alias("bad")), labelled, smoothing)
    return first, final


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", **options) -> DataFrame:
    """(id, host, path, rule, verdict, score, words) of every row of ``pages``.

    The longest fitting rule decides; else a url is blocked if its log odds are
    over ``threshold``. A null url, or one without ``://``, has an empty host
    and path, no rule and no words, and is judged by the prior alone. Null
    texts count no words; ids may be null or repeat; an empty table gives an
    empty result; other columns are not read. ``options`` go to ``train_bayes``.
    """
    rules = tuple(rules)

    def parse(batches):
        named = pa.list_(pa.struct([("name", pa.string()), ("of_path", pa.bool_())]))
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            fits = [fitting_rule(h, p, rules) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([f and f[0] for f in fits], pa.string()),
                    pa.array([f and f[1] for f in fits], pa.string()),
                    pa.array([[{"name": x, "of_path": y} for x, y in names_of(h, p)] for h, p in parts], named),
                ],
                names=[id_col, "host", "path", "rule", "said", "names"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    parsed = in_batches(pages, [id_col, url_col], parse, f"`{id_col}` {kind}, host string, path string, rule string, said string, names array<struct<name:string,of_path:boolean>>")
    parsed = materialise(parsed.withColumn("row", F.monotonically_increasing_id()), "urls")
    tokens = words_of_urls(parsed, materialise(word_counts(pages, text_col), "url-unigrams"))
    rows = materialise(parsed.select("row").join(tokens, "row", "left").select("row", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")), "url-rows")
    model = train_bayes(rows, **options)[1]
    score = scores(rows.select("row", F.explode("tokens").alias("token")), model)
    out = parsed.join(rows, "row").join(score, "row", "left").withColumn("score", F.coalesce("score", F.lit(model.prior)))
    verdict = F.coalesce("said", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score", F.col("tokens").alias("words"))

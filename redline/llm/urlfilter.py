"""URL verdicts: rules first, then naive Bayes on the words of host and path.

Host names are split into labels at dots and other bytes than letters, and each
label into words by a unigram Viterbi: the split with the largest sum of log
probabilities, where a word of the corpus counts by its frequency and any other
run of n letters has probability (1 / N) * 10^-n, N being all words of the
corpus.  Equal sums: the split whose last word is longest.  Path words are the
runs of letters or digits of each path segment.

The multinomial classifier learns from the urls themselves, one vote per different
host and path: a url is an example of the blocked class if a word of its segmented
host is a ``seed`` word, of the other class if not.  The seed words themselves are
left out of half of the votes, so the words beside them get their share.  Counts
are smoothed by 1.  A url is blocked if its score is above 0 in log odds.

Word counts come from all texts of the pages, markup aside.  Only the counts of
runs of letters that host labels contain are needed: labels are split into all
their runs, different ones meet the counts in a join, and each label is then
solved alone; no vocabulary is held in one place.

A null url, or one without ``://``, has empty host and path, no rule and is
allowed.  Equal urls get equal verdicts; a table without pages gives no rows.
Only page_id, url and html are read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.sources.shared import keep_narrow

#: Words of hosts that are blocked without further evidence.
SEEDS = ("spam", "pills", "casino", "adult", "bets", "porn", "ads", "viagra", "xxx", "loans")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; rules are (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(html: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts of ``html``, markup aside, in small letters."""
    text = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " ")
    return html.select(F.explode(F.split(F.lower(text), "[^\\p{L}]+")).alias("word")).where(
        F.col("word") != ""
    ).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, log_p: dict[str, float], total: float) -> list[str]:
    """The likeliest split of a label; log_p has the words of the corpus it contains.

    Runs longer than all of those are unknown, so the best of them is the one of the
    best begin so far, and a label costs its length times that of its longest word.
    """
    best, back = [0.0], [0]
    other, longest = math.log(max(total, 1.0)), max(map(len, log_p), default=1)
    far, far_at = -math.inf, 0  # of begins before the window, with their letters taken off
    for end in range(1, len(label) + 1):
        low = max(0, end - longest)
        if low and best[low - 1] + (low - 1) * math.log(10) > far:
            far, far_at = best[low - 1] + (low - 1) * math.log(10), low - 1
        top, at = far - other - end * math.log(10), far_at
        for begin in range(low, end):
            p = log_p.get(label[begin:end], -other - (end - begin) * math.log(10))
            if best[begin] + p > top:
                top, at = best[begin] + p, begin
        best.append(top)
        back.append(at)
    words, end = [], len(label)
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def labels_of(host: Column) -> Column:
    return F.filter(F.split(host, "[^\\p{L}]+"), lambda x: x != "")


def segment(hosts: DataFrame, html: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``label``, ``words`` for every different label of ``host``; a seed word counts once more than the corpus has it."""
    labels = hosts.select(F.explode(labels_of(F.col("host"))).alias("label")).distinct()
    extra = hosts.sparkSession.createDataFrame([(w, 1) for w in seeds], "word string, n long")
    counts = keep_narrow(word_counts(html).unionByName(extra).groupBy("word").agg(F.sum("n").alias("n")))
    total, longest = counts.agg(F.sum("n"), F.max(F.length("word"))).first()
    total, size = float(total or 0), F.length("label")
    # no longer run of a label can be a word
    runs = labels.select("label", F.explode(F.sequence(F.lit(1), size)).alias("begin")).select(
        "label", "begin", F.explode(F.sequence(F.lit(1), F.least(size - F.col("begin") + 1, F.lit(longest or 1)))).alias("n_letters")
    ).select("label", F.substring(F.col("label"), F.col("begin"), F.col("n_letters")).alias("word")).distinct()
    known = runs.join(counts, "word").groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.log(F.col("n") / F.lit(max(total, 1.0)))))).alias("log_p")
    )

    def solve(batches):
        for batch in batches:
            words = [
                viterbi(label, dict(p or ()), total)
                for label, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["label", "words"]
            )

    return labels.join(known, "label", "left").select("label", "log_p").mapInArrow(solve, "label string, words array<string>")


def _tokens(places: DataFrame, words: DataFrame) -> DataFrame:
    """``host``, ``path``, ``token``: h: words of the host, p: words of the path."""
    of_host = places.select("host").distinct().select("host", F.explode(labels_of(F.col("host"))).alias("label")).join(
        words, "label"
    ).select("host", F.explode("words").alias("word"))
    host_tokens = places.join(of_host, "host").select("host", "path", F.concat(F.lit("h:"), "word").alias("token"))
    path_tokens = places.select(
        "host", "path", F.explode(F.filter(F.split(F.lower("path"), "[^\\p{L}0-9]+"), lambda x: x != "")).alias("word")
    ).select("host", "path", F.concat(F.lit("p:"), F.regexp_replace("word", "[0-9]+", "0")).alias("token"))
    return host_tokens.unionByName(path_tokens)


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``host_words`` of every page.

    Scores are summed over the tokens of each different host and path and joined
    back; a host with a third of all pages is a row there.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = keep_narrow(urls.where(F.col("host") != "").select("host", "path").distinct())
    words = keep_narrow(segment(places.select("host").distinct(), pages.select("html"), seeds))
    tokens = keep_narrow(_tokens(places, words))
    seed_tokens = [f"h:{s}" for s in seeds]
    seeded = tokens.where(F.col("token").isin(seed_tokens)).select("host").distinct().withColumn("bad", F.lit(True))
    labelled = tokens.join(seeded, "host", "left").withColumn("bad", F.coalesce("bad", F.lit(False))).where(
        ~F.col("token").isin(seed_tokens) | (F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 0)
    )
    counts = labelled.groupBy("token").agg(
        F.sum(F.col("bad").cast("long")).alias("b"), F.sum((~F.col("bad")).cast("long")).alias("g")
    )
    counts = keep_narrow(counts)
    n_b, n_g, size = (float(x or 0) for x in counts.agg(F.sum("b"), F.sum("g"), F.count(F.lit(1))).first())
    n, n_bad = (float(x or 0) for x in places.join(seeded, "host", "left").agg(
        F.count(F.lit(1)), F.sum(F.coalesce("bad", F.lit(False)).cast("long"))).first())
    prior = math.log((n_bad + 1) / (n - n_bad + 1))
    odds = counts.select(
        "token", (F.log((F.col("b") + 1) / F.lit(n_b + size)) - F.log((F.col("g") + 1) / F.lit(n_g + size))).alias("w")
    )
    scores = tokens.join(odds, "token").groupBy("host", "path").agg(F.sum("w").alias("sum"))
    named = places.join(scores, ["host", "path"], "left").select(
        "host", "path", (F.lit(prior) + F.coalesce("sum", F.lit(0.0))).alias("score")
    )
    split = places.select("host").distinct().select("host", F.posexplode(labels_of(F.col("host"))).alias("at", "label")).join(
        words, "label"
    ).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts")).select(
        "host", F.array_join(F.flatten("parts.words"), " ").alias("host_words")
    )
    ruled = urls.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.join(named, ["host", "path"], "left").join(split, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        "score", "host_words",
    )

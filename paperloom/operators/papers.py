"""Candidate papers: search hits, keep-first dedupe, selection, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import DEFAULT
from paperloom.functions import scores as S
from paperloom.operators import search as SE

#: Least log-likelihood of a phrase (chance 0.001), its longest length in words, and the phrases of ideas in one broadcast.
LEAST_LIKELIHOOD, LONGEST, BROADCAST_PHRASES = 10.83, 3, 500_000


def first_hits(hits: DataFrame) -> DataFrame:
    """hits(idea_id, keyword, kw_pos, rank, arxiv_id, ...) -> the first of each paper, by keyword, then rank; blank ids go."""
    rest = [c for c in hits.columns if c not in ("idea_id", "arxiv_id", "kw_pos", "rank")]
    known = hits.where(F.col("arxiv_id").isNotNull() & (F.col("arxiv_id") != ""))
    # A minimum meets in partial aggregates, so a paper that a third of all hits name is no large group.
    first = known.groupBy("idea_id", "arxiv_id").agg(F.min(F.struct("kw_pos", "rank", *rest)).alias("h"))
    return first.select("idea_id", "arxiv_id", "h.*").withColumnRenamed("keyword", "search_keyword")


def selected(papers: DataFrame, limit: int = DEFAULT.max_papers) -> DataFrame:
    """The first ``limit`` papers of each idea in order of arrival, with their ids paper_01, paper_02, ..."""
    turn = F.row_number().over(Window.partitionBy("idea_id").orderBy("kw_pos", "rank", "arxiv_id"))
    return papers.withColumn("paper_pos", turn).where(F.col("paper_pos") <= limit).withColumn("paper_id", F.format_string("paper_%02d", "paper_pos"))


def keywords(ideas: DataFrame, corpus: DataFrame, specific: int = 4, broad: int = 3) -> DataFrame:
    """ideas(idea_id, text), corpus(text) -> the ``specific`` rarest and the ``broad`` most common words of each idea.

    Words are letters only, four or more; counts are of corpus texts that hold the word, and only of words of the ideas.
    The stand-in for a language model that suggests keywords.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}]+")), lambda w: F.length(w) >= 4)
    own = ideas.select("idea_id", F.explode_outer(words(F.col("text"))).alias("word")).where("word is not null")
    df = corpus.select(F.explode_outer(words(F.col("text"))).alias("word")).join(own.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    known = own.join(df, "word", "left").select("idea_id", "word", F.coalesce("df", F.lit(0)).alias("df"))
    rare = F.row_number().over(Window.partitionBy("idea_id").orderBy("df", "word"))
    common = F.row_number().over(Window.partitionBy("idea_id").orderBy(F.desc("df"), "word"))
    ranked = known.select("*", rare.alias("r"), common.alias("c"))
    kind = F.when(F.col("r") <= specific, "specific").otherwise("broad")
    return ranked.where((F.col("r") <= specific) | (F.col("c") <= broad)).select("idea_id", "word", "df", kind.alias("kind"))


def _letters(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def _phrases(w: Column) -> Column:
    """Distinct rows of one to LONGEST neighbouring words of four letters or more, of the words ``w``, a plain column."""
    rows = every = F.transform(w, lambda x: F.when(F.length(x) >= 4, x))
    for n in range(1, LONGEST):
        left = F.greatest(F.size(w) - n, F.lit(0))
        rows = F.zip_with(F.slice(rows, 1, left), F.slice(w, n + 1, left), lambda p, x: F.when(p.isNotNull() & (F.length(x) >= 4), F.concat(p, F.lit(" "), x)))
        every = F.concat(every, rows)
    return F.array_compact(F.array_distinct(every))


def _likelihood(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of two events in n rows, which happen ``both``, ``a`` and ``b`` times."""

    def part(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * column))).otherwise(0.0)

    return 2 * (part(both, a, b) + part(a - both, a, n - b) + part(b - both, n - a, b) + part(n - a - b + both, n - a, n - b))


def keyphrases(ideas: DataFrame, corpus: DataFrame, specific: int = 4, broad: int = 3) -> DataFrame:
    """ideas(idea_id, text), corpus(text) -> (idea_id, kw_pos, phrase, df, likelihood, kind), what an idea is searched by.

    A phrase of several words counts if the corpus holds it, and more often than its first words and its last word meet by chance.
    It absorbs the shorter ones in it.  First come ``specific`` phrases: the longest, then the least accidental, then the rarest;
    then ``broad`` ones: of the others those that most texts hold.  ``df`` is the number of corpus texts with the phrase; phrases that
    no text holds come last.  Ideas without a word have no row.  The phrases of all ideas, a stated set, are broadcast to where the
    texts lie, at most BROADCAST_PHRASES at a time, and what is shuffled are partial counts.
    """
    own = ideas.select("idea_id", _letters(F.col("text")).alias("w")).select("idea_id", F.explode_outer(_phrases(F.col("w"))).alias("phrase")).where("phrase is not null")
    known = own.select("phrase").distinct()
    rows = corpus.select(_letters(F.col("text")).alias("w")).select(F.explode_outer(_phrases(F.col("w"))).alias("phrase"))
    slices, counted = max(1, -(-known.count() // BROADCAST_PHRASES)), None
    for i in range(slices):
        mine = known if slices == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(slices)) == i)
        part = rows.join(F.broadcast(mine), "phrase").groupBy("phrase").agg(F.count("*").alias("df"))
        counted = part if counted is None else counted.unionByName(part)
    n = corpus.agg(F.count("*").alias("n"))
    w = F.split("phrase", " ")
    size = F.size(w)
    rest = own.select("idea_id", "phrase", size.alias("size"), F.array_join(F.slice(w, 1, F.greatest(size - 1, F.lit(1))), " ").alias("head"), F.element_at(w, -1).alias("tail"))
    df = lambda c: counted.select(F.col("phrase").alias(c), F.col("df").alias(f"df_{c}"))
    full = rest.join(df("phrase"), "phrase", "left").join(df("head"), "head", "left").join(df("tail"), "tail", "left").join(n).fillna(0, ["df_phrase", "df_head", "df_tail"])
    both, a, b = F.col("df_phrase"), F.col("df_head"), F.col("df_tail")
    score = F.when(F.col("size") > 1, F.round(_likelihood(both, a, b, F.col("n")), 6)).otherwise(0.0)
    linked = (both > 0) & (both * F.col("n") > a * b) & (score >= LEAST_LIKELIHOOD)
    kept = full.select("idea_id", "phrase", "size", both.alias("df"), score.alias("likelihood"), ((F.col("size") == 1) | linked).alias("ok")).where("ok")
    # The phrases of one idea, as many as it has words, meet in its row, where the shorter are absorbed and the rest put in order.
    item = F.struct((F.col("df") == 0).alias("none"), (-F.col("size")).alias("less"), (-F.col("likelihood")).alias("minus"), "df", "phrase")
    found = kept.groupBy("idea_id").agg(F.sort_array(F.collect_list(item)).alias("p"))
    inside = lambda x, y: (y["less"] < x["less"]) & F.contains(F.concat(F.lit(" "), y["phrase"], F.lit(" ")), F.concat(F.lit(" "), x["phrase"], F.lit(" ")))
    found = found.withColumn("p", F.filter("p", lambda x: ~F.exists("p", lambda y: inside(x, y))))
    first = F.transform(F.slice("p", 1, specific), lambda x: F.struct(x["phrase"].alias("phrase"), x["df"].alias("df"), (-x["minus"]).alias("likelihood"), F.lit("specific").alias("kind")))
    others = F.sort_array(F.transform(F.filter("p", lambda x, i: i >= specific), lambda x: F.struct((-x["df"]).alias("less"), x["phrase"].alias("phrase"), (-x["minus"]).alias("likelihood"))))
    then = F.transform(F.slice(others, 1, broad), lambda x: F.struct(x["phrase"].alias("phrase"), (-x["less"]).alias("df"), x["likelihood"].alias("likelihood"), F.lit("broad").alias("kind")))
    return found.select("idea_id", F.posexplode(F.concat(first, then)).alias("kw_pos", "k")).select("idea_id", (F.col("kw_pos") + 1).alias("kw_pos"), "k.phrase", "k.df", "k.likelihood", "k.kind")


def ranked_hits(phrases: DataFrame, index: SE.Index, k: int = 10) -> DataFrame:
    """(idea_id, keyword, kw_pos, rank, doc_id, arxiv_id, score): for each phrase the ``k`` documents that suit its words best.

    phrases(idea_id, kw_pos, phrase); a document's number, as text, plays the paper's id.
    """
    asked = phrases.select(F.struct("idea_id", "kw_pos", "phrase").alias("query_id"), SE.words(F.col("phrase")).alias("terms"))
    hits = SE.search(asked, index, k)
    return hits.select("query_id.idea_id", F.col("query_id.phrase").alias("keyword"), "query_id.kw_pos", "rank", F.col("doc").alias("doc_id"), F.col("doc").cast("string").alias("arxiv_id"), "score")


def diverse(candidates: DataFrame, k: int = DEFAULT.max_papers, relevance: float = 0.7, most: int = 15) -> DataFrame:
    """candidates(idea_id, paper_id, relevance, covers: array<double>) -> (idea_id, paper_id, rank, gain), at most ``k`` for each idea.

    One after the other the paper is picked that gains most: its relevance less its likeness to the likest one picked before, weighed
    as ``relevance`` to the rest of 1.  Two papers are alike as far as ``covers``, what they hold of each part of the idea, agree: the
    sum of the parts' smaller values over that of the larger ones.  ``most`` candidates of the highest relevance take part.  Ties fall
    to the smaller id; null values count as 0.  The fold runs in the row of the idea, over ``most`` candidates.
    """
    turn = F.row_number().over(Window.partitionBy("idea_id").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "paper_id"))
    few = candidates.withColumn("turn", turn).where(F.col("turn") <= most)
    kind = candidates.schema["paper_id"].dataType.simpleString()
    item = F.struct("paper_id", F.coalesce("relevance", F.lit(0.0)).alias("relevance"), F.transform(F.coalesce("covers", F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0))).alias("covers"))
    rows = few.groupBy("idea_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def alike(a: Column, b: Column) -> Column:
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        both, either = (total(F.zip_with(a, b, lambda x, y: f(zero(x), zero(y)))) for f in (F.least, F.greatest))
        return F.when(either > 0, both / either).otherwise(0.0)

    picked = f"array<struct<paper_id:{kind},covers:array<double>,gain:double>>"

    def step(acc: Column, _: Column) -> Column:
        left = F.filter("c", lambda x: ~F.exists(acc, lambda p: p["paper_id"].eqNullSafe(x["paper_id"])))
        nearest = lambda x: F.coalesce(F.array_max(F.transform(acc, lambda p: alike(x["covers"], p["covers"]))), F.lit(0.0))
        gain = lambda x: S.rounded(relevance * x["relevance"] - (1 - relevance) * nearest(x))
        best = F.array_min(F.transform(left, lambda x, i: F.struct((-gain(x)).alias("less"), i.alias("i"), x["paper_id"].alias("paper_id"), x["covers"].alias("covers"))))
        return F.when(F.size(left) > 0, F.concat(acc, F.array(F.struct(best["paper_id"].alias("paper_id"), best["covers"].alias("covers"), (-best["less"]).alias("gain"))))).otherwise(acc)

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast(picked), step)
    return rows.select("idea_id", F.posexplode(chosen).alias("pos", "p")).select("idea_id", "p.paper_id", (F.col("pos") + 1).alias("rank"), "p.gain")

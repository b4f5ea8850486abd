"""Entity matching as distributed joins: countries by code and name, commodity codes by keyword and by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .edits import similarity_join
from .relational import best_match

#: English words that carry no meaning for matching.
STOP_WORDS = (
    "a", "about", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "for", "from", "had", "has", "have", "if", "in", "into", "is", "it",
    "its", "more", "no", "nor", "not", "of", "on", "only", "or", "other", "our", "out", "so", "such", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "to", "under", "up", "was", "were", "what", "when", "which", "who", "will", "with", "you", "your",
)


def variant_key(c: str) -> Column:
    """A name without its punctuation, its case and a leading article, as synonym tables list names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.col(c)), r"[^\p{L}\p{N}]+", " "), r"^ ?THE (?=.)", ""))


def resolve_country_by_code(df: DataFrame, ref: DataFrame, column: str = "partner_code") -> DataFrame:
    """Name, region and continent of the code; null for an unknown one, whatever the row held."""
    names = ["partner_name", "region", "continent"]
    r = ref.select(F.upper("iso3").alias("__code"), F.col("name").alias("partner_name"), "region", "continent")
    return df.drop(*names).join(r, F.upper(F.trim(F.col(column))) == F.col("__code"), "left").drop("__code")


def resolve_country_by_name(names: DataFrame, ref: DataFrame, aliases: DataFrame, floor: float = 70.0, variants: DataFrame | None = None) -> DataFrame:
    """(name, iso3, resolved_name, how) for each distinct name: alias, exact, else a variant, else the most similar above floor.

    variants (variant, iso3) is a table of synonyms such as official, short and foreign names; where one is given, every reference
    name is its own variant too, and a variant that stands for several countries resolves none. Only names that are left by
    these go into the join by edit distance, which finds all reference names above floor."""
    asked = names.select(F.trim("name").alias("name")).where("name <> ''").distinct().withColumn("key", F.upper("name"))
    exact = ref.select(F.upper("name").alias("key"), F.col("iso3").alias("e_iso"), F.col("name").alias("e_name"))
    alias = aliases.select(F.upper("alias").alias("key"), F.upper("name").alias("a_key")).join(exact.select(F.col("key").alias("a_key"), F.col("e_iso").alias("a_iso"), F.col("e_name").alias("a_name")), "a_key").drop("a_key")
    spelled = ref.select(variant_key("name").alias("v_key"), "iso3")
    if variants is None:
        spelled = spelled.where("false")
    else:
        spelled = spelled.unionByName(variants.select(variant_key("variant").alias("v_key"), "iso3").join(ref.select("iso3"), "iso3", "left_semi"))
    one = spelled.where("v_key <> ''").groupBy("v_key").agg(F.min("iso3").alias("v_iso"), F.max("iso3").alias("other")).where("v_iso = other").drop("other")
    variant = one.join(ref.select(F.col("iso3").alias("v_iso"), F.col("name").alias("v_name")), "v_iso")
    known = asked.join(alias, "key", "left").join(exact, "key", "left").withColumn("v_key", variant_key("name")).join(variant, "v_key", "left").drop("v_key")
    left = known.where("a_iso is null and e_iso is null and v_iso is null").select("key").distinct()
    pairs = similarity_join(left, exact.select("key"), floor).where(F.col("score") > floor).withColumnsRenamed({"a": "key", "b": "r_key"})
    best = best_match(pairs, "key", "score", "r_key", floor)
    fuzzy = best.join(exact.select(F.col("key").alias("r_key"), F.col("e_iso").alias("f_iso"), F.col("e_name").alias("f_name")), "r_key").select("key", "f_iso", "f_name")
    how = F.when(F.col("a_iso").isNotNull(), "alias").when(F.col("e_iso").isNotNull(), "exact").when(F.col("v_iso").isNotNull(), "variant").when(F.col("f_iso").isNotNull(), "fuzzy").otherwise("unresolved")
    return known.join(fuzzy, "key", "left").select("name", F.coalesce("a_iso", "e_iso", "v_iso", "f_iso").alias("iso3"), F.coalesce("a_name", "e_name", "v_name", "f_name", "name").alias("resolved_name"), how.alias("how"))


def keyword_text(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "))


def infer_by_keyword(df: DataFrame, rules: list[tuple[str, str]], column: str) -> DataFrame:
    """df with inferred_code: that of the first rule (keyword, code) in order whose keyword the text holds."""
    text, code = keyword_text(column), F.lit(None).cast("string")
    for word, value in reversed(rules):
        code = F.when(text.contains(word), value).otherwise(code)
    return df.withColumn("inferred_code", code)


def grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, tf): words of two letters or more that are no stop words, and pairs of neighbours."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    n = F.size("w")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    return df.select(key, words.alias("w")).select(key, F.explode(F.concat("w", pairs)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


#: Scores are rounded to nine places; bounds on them give way by this much.
SLACK = 2e-9
#: Steps of the norm that an indexed gram and what follows it have left.
STEPS = 16


def vectors(own: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, v): unit vectors of tf x idf as arrays of (gram, w, rest), the rarest gram first; rest is the norm of a gram and all
    behind it."""
    w = own.join(idf, "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "gram", (F.col("tf") * F.col("idf")).alias("w")))).alias("g"))
    unit = w.withColumn("norm", F.expr("sqrt(aggregate(g, 0D, (s, x) -> s + x.w * x.w))"))
    rest = "sqrt(aggregate(slice(g, i + 1, size(g)), 0D, (s, y) -> s + y.w * y.w)) / norm"
    return unit.select(key, F.expr(f"transform(g, (x, i) -> struct(x.gram as gram, x.w / norm as w, {rest} as rest))").alias("v"))


def tfidf_best_match(queries: DataFrame, corpus: DataFrame, floor: float = 0.2) -> DataFrame:
    """(query_id, doc_id, score): the corpus text with the highest cosine of tf-idf weights (idf ln((1+n)/(1+df))+1
    over the corpus, unit vectors), at or above floor (ties: the smallest doc_id).

    Grams are taken from the rarest on, in one order for all vectors. A pair whose first common gram leaves the norms x and y on the
    two sides scores x y at most. So a query first gets a best score to beat, from the texts in which its grams weigh
    most; then it looks up its grams only as long as what is left of it can still reach that, and only at entries of the
    index that leave enough norm on their side. A gram that most texts share comes last and leaves little of either."""
    own, asked = grams(corpus, "doc_id", "text"), grams(queries, "query_id", "text")
    n = corpus.agg(F.count("*").alias("n")).scalar()
    idf = own.groupBy("gram").agg(F.count("*").alias("df")).select("gram", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
    q, d = vectors(asked, idf, "query_id"), vectors(own, idf, "doc_id")
    spread = lambda v, key, more=(): v.select(key, *more, F.explode("v").alias("x")).select(key, *more, "x.gram", "x.w", "x.rest")
    entries = spread(d, "doc_id").where(F.col("rest") >= floor - SLACK)
    held = d.select("doc_id", F.expr("map_from_arrays(transform(v, x -> x.gram), transform(v, x -> x.w))").alias("weights"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(held, "doc_id").join(q.select("query_id", "v"), "query_id")
        return met.select("query_id", "doc_id", F.expr("round(aggregate(v, 0D, (s, x) -> s + x.w * coalesce(weights[x.gram], 0D)), 9)").alias("score"))

    heaviest = entries.groupBy("gram").agg(F.max_by("doc_id", F.struct("w", "doc_id")).alias("doc_id"))
    first = scored(spread(q, "query_id").join(heaviest, "gram").select("query_id", "doc_id").distinct())
    bar = first.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(floor)).alias("bar"))
    step = lambda c: F.floor(F.col(c) * STEPS).cast("int")
    least = F.floor((F.col("bar") - SLACK) / F.col("rest") * STEPS).cast("int")
    asking = spread(q.join(bar, "query_id"), "query_id", ("bar",)).where(F.col("rest") >= F.col("bar") - SLACK)
    asking = asking.select("query_id", "gram", "bar", F.col("rest").alias("x"), F.explode(F.sequence(F.least(least, F.lit(STEPS)), F.lit(STEPS))).alias("step"))
    index = entries.select("doc_id", "gram", F.col("rest").alias("y"), F.least(step("rest"), F.lit(STEPS)).alias("step"))
    met = asking.join(index, ["gram", "step"]).where(F.col("x") * F.col("y") >= F.col("bar") - SLACK).select("query_id", "doc_id").distinct()
    return best_match(scored(met), "query_id", "score", "doc_id", floor)


def token_sort_match(queries: DataFrame, corpus: DataFrame, cutoff: float = 60.0) -> DataFrame:
    """(query_id, doc_id, score): the most similar text once words are sorted, at or above cutoff (ties: the smallest doc_id).
    Distinct sorted texts are joined by edit distance, which finds all at cutoff or above."""
    ordered = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")), " ")
    q, d = queries.select("query_id", ordered("text").alias("a")), corpus.select("doc_id", ordered("text").alias("b"))
    near = similarity_join(q.select("a"), d.select("b"), cutoff)
    named = near.join(d.groupBy("b").agg(F.min("doc_id").alias("doc_id")), "b")
    return best_match(q.join(best_match(named, "a", "score", "doc_id", cutoff), "a").select("query_id", "doc_id", "score"), "query_id", "score", "doc_id", cutoff)


def infer_codes(df: DataFrame, key: str, text: str, code: str, rules: list[tuple[str, str]], corpus: DataFrame) -> DataFrame:
    """df with blank codes filled by keyword, else by tf-idf match, else by token-sort match, else null; corpus has
    (doc_id, text) with the code as doc_id. Texts to match and their codes are stored, so that rows are joined with tables of known
    size."""
    ruled = infer_by_keyword(df, rules, text)
    known = F.nullif(F.trim(F.col(code)), F.lit(""))
    todo = ruled.where(known.isNull() & F.col("inferred_code").isNull()).select(F.col(text).alias("text")).distinct().withColumn("query_id", F.col("text"))
    todo = kept(todo, "texts")
    by_text = kept(tfidf_best_match(todo, corpus).select(F.col("query_id").alias("__t"), F.col("doc_id").alias("__tfidf")), "codes")
    rest = todo.join(by_text, todo.query_id == by_text["__t"], "left_anti")
    by_sort = kept(token_sort_match(rest, corpus).select(F.col("query_id").alias("__s"), F.col("doc_id").alias("__sort")), "codes")
    joined = ruled.join(by_text, F.col(text) == F.col("__t"), "left").join(by_sort, F.col(text) == F.col("__s"), "left")
    return joined.withColumn(code, F.coalesce(known, "inferred_code", "__tfidf", "__sort")).select(*df.columns)

"""The queries of the core, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.rng import uniform
from lexiloom.functions.tokens import join_tokens, split_tokens, token_rows
from lexiloom.operators import alpha as prior
from lexiloom.operators import counts as C
from lexiloom.operators import gibbs as G
from lexiloom.operators import scores as S
from lexiloom.operators import vocabulary as V
from lexiloom.operators.generate import generate_documents, generate_texts
from lexiloom.operators.ordering import dense_ids
from lexiloom.plans import lda
from lexiloom.plans.pipeline import Pipeline
from lexiloom.sources.stopwords import default_stopwords, stopword_table
from lexiloom.sources.text_files import read_lines
from lexiloom.storage import materialise, new_path, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Topics of ``corpus``, and those of the small models trained here.
N_TOPICS, FEW_TOPICS = 50, 3
ALPHA = (lda.FIRST_ALPHA,) * N_TOPICS
CUSTOM_STOPWORDS = ("the", "topic", "and", "documents")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _cleaned(spark: SparkSession, d: str, *steps: T.Step) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.clean(F.col("text"), steps).alias("text"))


def _flat(tokens: Column) -> Column:
    return F.array_join(tokens, "|")


# --- cleaning -----------------------------------------------------------------


def _cleaning(name: str, *steps: T.Step) -> None:
    QUERIES[name] = lambda spark, d: _cleaned(spark, d, *steps)


_cleaning("clean_lower", T.lower_case)
_cleaning("clean_punct", T.punctuation_to_space)
_cleaning("clean_chars", T.keep_plain_characters)
_cleaning("clean_numbers", T.keep_plain_characters, T.remove_numbers)
_cleaning("clean_whitespace", T.collapse_white_space)
_cleaning("clean_default", *T.DEFAULT_STEPS)
_cleaning("clean_custom", T.lower_case, T.collapse_white_space, lambda c: F.replace(c, F.lit("topic"), F.lit("theme")))


@query
def clean_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs planted before and after every text are deleted, with what is glued to them."""
    text = F.concat(F.lit("see:http://a.example/x?y=1 "), "text", F.lit(" at https://b.example/"))
    return _docs(spark, d).select("doc_id", T.remove_urls(text).alias("text"))


@query
def clean_python(spark: SparkSession, d: str) -> DataFrame:
    """A step of the user's own in plain Python, between two that are built in."""
    return _cleaned(spark, d, T.lower_case, T.python_step(_swapped), T.punctuation_to_space)


def _swapped(text: str) -> str:
    return text.replace("topic", "theme")


# --- text files ----


def _lines_of(spark: SparkSession, texts: DataFrame, charset: str) -> DataFrame:
    """Texts in the order of ``doc_id`` as text files, read line by line."""
    path = new_path(spark, "text")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text")
    # a writer that knows charsets; quotes, escapes and separators are turned off
    plain = {"encoding": charset, "quote": "", "sep": "\u0001", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if charset == "UTF-8":
        ordered.write.text(path)
    else:
        ordered.write.options(**plain).csv(path)
    return read_lines(spark, path, charset)


@query
def scan_text(spark: SparkSession, d: str) -> DataFrame:
    """The documents as UTF-8 files, every line a document of its own."""
    return _lines_of(spark, _docs(spark, d), "UTF-8")


@query
def scan_charset(spark: SparkSession, d: str) -> DataFrame:
    """The documents as Latin-1 files, one quoted line each."""
    one_line = F.concat(F.lit("> "), F.regexp_replace("text", "[\\x00-\\x1f]+", " "))
    return _lines_of(spark, _docs(spark, d).select("doc_id", one_line.alias("text")), "ISO-8859-1")


@query
def scan_texts(spark: SparkSession, d: str) -> DataFrame:
    """The small table of reading samples as a list of texts in memory, put through the pipeline that changes nothing."""
    rows = read_table(spark, d, "reading_samples").orderBy("sample_id").collect()
    corpus = Pipeline.noop().run_texts(spark, [r["text"] for r in rows])
    return V.decode(corpus.tokens, corpus.dictionary)


# --- tokens -------------------------------------------------------------------


@query
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    tokens = split_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", _flat(tokens).alias("tokens"), F.size(tokens).alias("n_tokens"))


@query
def tokenise_delim(spark: SparkSession, d: str) -> DataFrame:
    tokens = split_tokens(F.col("text"), "[,;]+")
    return _docs(spark, d).select("doc_id", _flat(tokens).alias("tokens"), F.size(tokens).alias("n_tokens"))


def _tokenised(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline.default().tokenise(_docs(spark, d))


@query
def explode_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokenised(spark, d)


@query
def detokenise(spark: SparkSession, d: str) -> DataFrame:
    return join_tokens(_tokenised(spark, d))


# --- stopwords and filters ----------------------------------------------------


@query
def stopwords_table(spark: SparkSession, d: str) -> DataFrame:
    return stopword_table(spark, default_stopwords())


def _unstopped(spark: SparkSession, d: str) -> DataFrame:
    return V.remove_stopwords(_tokenised(spark, d))


@query
def stopwords_removed(spark: SparkSession, d: str) -> DataFrame:
    return _unstopped(spark, d)


@query
def stopwords_custom(spark: SparkSession, d: str) -> DataFrame:
    return V.remove_stopwords(_tokenised(spark, d), CUSTOM_STOPWORDS)


@query
def empty_docs(spark: SparkSession, d: str) -> DataFrame:
    return V.empty_documents(_docs(spark, d), _unstopped(spark, d).filter("token <> ''"))


@query
def filter_settings(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of the default filter, and of one with all bounds switched on."""
    every = V.TokenFilter().use(**dict.fromkeys(V.TokenFilter.SWITCHED_ON, True))
    rows = [(kind, name, float(value)) for kind, f in (("default", V.TokenFilter.default()), ("all", every)) for name, value in f.bounds().items()]
    return spark.createDataFrame(rows, "kind string, bound string, value double")


@query
def nothing_left(spark: SparkSession, d: str) -> DataFrame:
    """Whether filters that leave no token of the documents are refused."""
    try:
        V.require_tokens(V.filter_tokens(_tokenised(spark, d), _docs(spark, d), V.TokenFilter(min_length=1_000_000)))
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


FILTERS = {
    "filter_max_freq": V.TokenFilter(max_freq=200),
    "filter_min_freq": V.TokenFilter(min_freq=10),
    "filter_max_perc": V.TokenFilter(max_share=0.25),
    "filter_min_perc": V.TokenFilter(min_share=0.05),
    "filter_max_docs": V.TokenFilter(max_docs=100),
    "filter_min_docs": V.TokenFilter(min_docs=5),
    "filter_max_length": V.TokenFilter(max_length=6),
    "filter_min_length": V.TokenFilter(min_length=3),
}
QUERIES |= {name: lambda spark, d, b=bounds: V.filter_tokens(_unstopped(spark, d), _docs(spark, d), b) for name, bounds in FILTERS.items()}


@query
def preprocess_default(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline.default().tokens(_docs(spark, d))


@query
def preprocess_noop(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline.noop().tokens(_docs(spark, d))


@query
def kept_total(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(_unstopped(spark, d), "unstopped")
    return V.kept_and_total(rows, V.filter_tokens(rows, _docs(spark, d), V.TokenFilter.default()))


@query
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return V.term_statistics(_unstopped(spark, d)).select("token", "freq")


@query
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return V.term_statistics(_unstopped(spark, d)).select("token", "doc_freq")


# --- dictionary and encoding --------------------------------------------------


@query
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Words of the default pipeline, numbered by first occurrence, with their frequency."""
    return V.build_dictionary(preprocess_default(spark, d))


@query
def doc_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return dense_ids(_docs(spark, d).select("doc_id"), ["doc_id"], "ordinal").select("doc_id", "ordinal")


def _token_table(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "tokens").filter("token <> ''")
    return rows.groupBy("doc_id", "pos").agg(F.min("token").alias("token"))


def _dictionary_table(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "dictionary").select("word_id", "token")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_corpus(read_table(spark, d, "corpus"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "doc_index").select("doc_id")


@query
def encode_corpus(spark: SparkSession, d: str) -> DataFrame:
    return V.encode(_token_table(spark, d), _dictionary_table(spark, d))


@query
def decode_corpus(spark: SparkSession, d: str) -> DataFrame:
    return V.decode(_corpus(spark, d), _dictionary_table(spark, d))


@query
def dict_contains(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the documents that the training dictionary has."""
    return V.known_tokens(_tokenised(spark, d), _dictionary_table(spark, d))


@query
def dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    return V.look_up(V.term_statistics(_unstopped(spark, d)).select("token"), _dictionary_table(spark, d))


# --- counts -------------------------------------------------------------------


@query
def corpus_scalars(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus_scalars(_corpus(spark, d), _dictionary_table(spark, d), _index(spark, d))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return C.document_lengths(_corpus(spark, d), _index(spark, d))


@query
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d)


@query
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.topic_counts(_corpus(spark, d))


@query
def word_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.word_topic_counts(_corpus(spark, d))


@query
def doc_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.document_topic_counts(_corpus(spark, d))


@query
def count_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return C.all_counts(_corpus(spark, d))


@query
def max_doc_length(spark: SparkSession, d: str) -> DataFrame:
    return C.longest(_lengths(spark, d))


@query
def mean_doc_length(spark: SparkSession, d: str) -> DataFrame:
    return C.mean_length(_lengths(spark, d)).select(F.round("mean_length", 6).alias("mean_length"))


@query
def doc_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return C.length_histogram(_lengths(spark, d))


@query
def doc_topic_hist(spark: SparkSession, d: str) -> DataFrame:
    return C.document_topic_histogram(_corpus(spark, d), _index(spark, d), N_TOPICS)


@query
def topic_max_count(spark: SparkSession, d: str) -> DataFrame:
    return C.highest_bucket(doc_topic_hist(spark, d), N_TOPICS)


# --- distributions and scores ---------------------------------------------------


def _phi(spark: SparkSession, d: str) -> DataFrame:
    return S.phi_vectors(_corpus(spark, d), _dictionary_table(spark, d), N_TOPICS)


def _rounded(vectors: DataFrame, key: str, value: str) -> DataFrame:
    return S.by_topic(vectors, key, value).withColumn(value, F.round(value, 10))


@query
def phi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_phi(spark, d), "word_id", "phi")


@query
def theta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.theta_vectors(_corpus(spark, d), _index(spark, d), ALPHA), "doc_id", "theta")


@query
def geometric_mean(spark: SparkSession, d: str) -> DataFrame:
    return S.geometric_mean(_phi(spark, d)).select("word_id", F.round("geomean", 10).alias("geomean"))


@query
def phi_column_sum(spark: SparkSession, d: str) -> DataFrame:
    return S.column_sum(S.by_topic(_phi(spark, d), "word_id", "phi")).select("topic", F.round("phi_sum", 6).alias("phi_sum"))


@query
def phi_column(spark: SparkSession, d: str) -> DataFrame:
    return S.column(phi(spark, d), 7)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_scores(_phi(spark, d), _dictionary_table(spark, d))


@query
def term_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("topic", "term", F.round("score", 8).alias("score"))


def _ranked(spark: SparkSession, d: str, n: int) -> DataFrame:
    return S.top_terms(_scores(spark, d), n).withColumn("score", F.round("score", 8))


@query
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 10)


@query
def top_terms_all(spark: SparkSession, d: str) -> DataFrame:
    """All terms by their scores as they are, not rounded: only equal scores are tied."""
    return _ranked(spark, d, 0)


@query
def top_terms_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with the scores as they are."""
    return S.top_terms(_scores(spark, d), 0)


@query
def topic_words(spark: SparkSession, d: str) -> DataFrame:
    return S.topic_words(S.topics_nested(_ranked(spark, d, 10))).select("topic", _flat(F.col("words")).alias("words"))


@query
def topic_display(spark: SparkSession, d: str) -> DataFrame:
    return S.topic_display(S.topics_nested(_ranked(spark, d, 10)))


@query
def score_equality(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair of term and score was delivered: two are equal if both parts are."""
    pairs = read_table(spark, d, "term_scores").select(F.struct("term", "score").alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select("pair.term", "pair.score", "n_rows")


@query
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    n_words = _dictionary_table(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar()
    return S.assigned_perplexity(_corpus(spark, d), n_words, ALPHA).select(F.round("perplexity", 4).alias("perplexity"))


@query
def phi_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the phi of the counts and the one of drawn topics."""
    drawn = S.phi_vectors(G.init_topics(_corpus(spark, d), N_TOPICS, 7), _dictionary_table(spark, d), N_TOPICS)
    summed = S.add_vectors(_phi(spark, d), drawn, "word_id", "phi").withColumnRenamed("phi", "phi_sum")
    return _rounded(summed, "word_id", "phi_sum").withColumn("samples", F.lit(2))


@query
def reload_sums(spark: SparkSession, d: str) -> DataFrame:
    """The sums that the saved models' phi stand for."""
    samples = read_table(spark, d, "models").filter("samples > 0").select("run_id", "samples")
    rows = read_table(spark, d, "phi").filter("phi IS NOT NULL AND NOT isnan(phi)").distinct().join(samples, "run_id")
    return S.sums_of_model(rows, "phi", F.col("samples")).select("run_id", "topic", "word_id", "phi_sum")


# --- sampling -----------------------------------------------------------------


@query
def init_topics(spark: SparkSession, d: str) -> DataFrame:
    return G.init_topics(_corpus(spark, d), N_TOPICS, 7)


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    n_words = _dictionary_table(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar()
    return materialise(init_topics(spark, d), "drawn"), n_words


@query
def gibbs_conditional(spark: SparkSession, d: str) -> DataFrame:
    """The weights of all topics of every token, in units of 1e-12."""
    rows = G.conditional(*_drawn(spark, d), ALPHA)
    units = F.transform("weights", lambda p: F.round(p * F.lit(1e12)).cast("long").cast("string"))
    return rows.select("doc_id", "pos", _flat(units).alias("weights"))


@query
def gibbs_sweep(spark: SparkSession, d: str) -> DataFrame:
    return G.synchronous_sweep(*_drawn(spark, d), ALPHA, seed=7)


#: Topics of the model of the reading samples.
KERNEL_TOPICS = 5


@query
def gibbs_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Topics of all tokens of the reading samples after one sweep of the kernel that trains."""
    texts = read_table(spark, d, "reading_samples").select(F.col("sample_id").cast("long").alias("doc_id"), "text")
    model = lda.new_model(Pipeline.noop().run(texts), KERNEL_TOPICS, seed=5)
    swept = lda.swept(model, 0, model.dictionary.count())
    return swept.corpus().join(model.dictionary, "word_id").select("doc_id", "pos", "token", "topic")


@query
def multinomial_draw(spark: SparkSession, d: str) -> DataFrame:
    """One topic for every document, drawn from its tokens' topics."""
    weights = C.document_topic_counts(_corpus(spark, d)).withColumn("w", F.col("n") + F.lit(0.5))
    return G.draw(weights, ["doc_id"], "topic", "w", uniform(11, "doc_id"), "topic")


@query
def alpha_iteration(spark: SparkSession, d: str) -> DataFrame:
    """The priors after ten iterations from the corpus's histograms."""
    lengths = {r["n_tokens"]: r["n_docs"] for r in doc_length_hist(spark, d).toLocalIterator()}
    by_topic: list[dict[int, int]] = [{} for _ in range(N_TOPICS)]
    for r in doc_topic_hist(spark, d).toLocalIterator():
        by_topic[r["topic"]][r["n"]] = r["n_docs"]
    alpha = prior.optimise_alpha(ALPHA, lengths, by_topic)
    return spark.createDataFrame([(k, round(a, 8)) for k, a in enumerate(alpha)], "topic int, alpha double")


@query
def cycle_schedule(spark: SparkSession, d: str) -> DataFrame:
    """What each of a thousand cycles does under the usual schedule."""
    s = lda.Schedule()
    c = F.col("cycle")
    row = spark.range(1000).select(F.col("id").alias("cycle"))
    return row.select("cycle", s.kind(c).alias("kind"), ((c >= s.burn_in) & (c % s.optimise_lag == 0)).alias("optimises"), ((c >= s.burn_in) & (c % s.sample_lag == 0)).alias("samples"), (c % s.perplexity_lag == 0).alias("checks"))


@query
def alpha_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number and sum of these priors, and whether any is negative."""
    a = alpha_iteration(spark, d)
    return a.agg(F.count(F.lit(1)).alias("n_topics"), F.round(F.sum("alpha"), 6).alias("alpha_sum"), F.bool_or(F.col("alpha") < 0).alias("any_negative"))


_SHORT = lda.Schedule(burn_in=4, sample_lag=2, optimise_lag=3, perplexity_lag=5)
_CYCLES = 8


def _new(spark: SparkSession, d: str) -> lda.Model:
    return lda.new_model(Pipeline.default().run(_docs(spark, d)), FEW_TOPICS, seed=1)


def _trained(spark: SparkSession, d: str) -> lda.Model:
    return lda.train(_new(spark, d), _CYCLES, _SHORT)


@query
def train(spark: SparkSession, d: str) -> DataFrame:
    """Topics of a model trained on all documents for a few cycles."""
    return _trained(spark, d).top_terms(10)


@query
def train_history(spark: SparkSession, d: str) -> DataFrame:
    """What the cycles of such a training did."""
    rows = [(c, kind, p) for c, kind, p, _ in _trained(spark, d).history]
    return spark.createDataFrame(rows, "cycle int, kind string, perplexity double")


@query
def train_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of its cycles, which checked the perplexity, and whether the seconds were taken."""
    model = _trained(spark, d)
    rows = [(c, kind, p is not None, seconds > 0 and model.mean_seconds > 0) for c, kind, p, seconds in model.history]
    return spark.createDataFrame(rows, "cycle int, kind string, checked boolean, timed boolean")


@query
def train_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Training, saving, loading and training on against training through: tokens of the same topic, and what else is equal."""
    first = _new(spark, d)
    through = lda.train(first, _CYCLES, _SHORT)
    path = new_path(spark, "model")
    lda.train(first, _CYCLES // 2, _SHORT).save(path)
    resumed = lda.train(lda.Model.load(spark, path), _CYCLES // 2, _SHORT)
    equal = (through.alpha, through.samples, through.cycles) == (resumed.alpha, resumed.samples, resumed.cycles)
    both = through.corpus().join(resumed.corpus().withColumnRenamed("topic", "again"), ["doc_id", "pos", "word_id"])
    return both.agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.when(F.col("topic") == F.col("again"), 1).otherwise(0)).alias("same_topic"), F.lit(equal).alias("same_model"))


@query
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a new model says of itself and of its corpus."""
    m = _new(spark, d)
    corpus = m.corpus()
    of_corpus = C.corpus_scalars(corpus, m.dictionary, m.doc_index)
    return of_corpus.select("*", F.lit(m.n_topics).alias("n_topics"), F.lit(m.beta).alias("beta"), F.lit(round(sum(m.alpha), 8)).alias("alpha_sum"), F.lit(m.samples).alias("samples"), F.lit(m.cycles).alias("cycles"), F.lit(round(m.mean_length(), 6)).alias("mean_length"))


def _generated(spark: SparkSession, d: str, n_docs: int) -> DataFrame:
    """Documents from the distributions of ``corpus``."""
    n_d = C.mean_length(_lengths(spark, d)).first()["mean_length"]
    rows = materialise(S.by_topic(_phi(spark, d), "word_id", "phi"), "phi")
    return generate_documents(spark, n_docs, ALPHA, rows, n_d, seed=3)


@query
def generate_ids(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d, 1000)


@query
def generate_text(spark: SparkSession, d: str) -> DataFrame:
    return generate_texts(spark, 1000, _generated(spark, d, 1000), _dictionary_table(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean, tokenise, filter, encode, train and rank: the terms of three topics."""
    return train(spark, d)

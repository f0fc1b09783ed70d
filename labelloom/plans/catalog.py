"""The library's operators as named queries over the given tables.

Documents are labelled by language, vectors by their class; replies and losses are derived from
the rows, so every query's work grows with its table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.hashing import cache_key, order_key, text_key, uniform
from labelloom.functions.labels import decode_label, encode_label, map_values, one_hot
from labelloom.functions.replies import read_replies
from labelloom.functions.text import head_tokens, row_as_text, tokens
from labelloom.functions.vectors import (
    argmax,
    argmin,
    array_total,
    cross_entropy,
    distance,
    kl_divergence,
    log_softmax,
    soft_cross_entropy,
    softmax,
)
from labelloom.operators import annotate as ann
from labelloom.operators import diversity, label_index, metrics, noise, sampling
from labelloom.operators.augment import drop_words, expand_corpus, mangle, mixup
from labelloom.operators.classify import Classifier, embed, train_robust
from labelloom.operators.embedding import fit_pooler
from labelloom.operators.joins import fan_out_join
from labelloom.plans.loop import label_loop, latest_annotations, pending_texts, training_rows
from labelloom.session import new_run_dir, spread
from labelloom.sources import cache as replies_cache
from labelloom.sources import corpus as corpora

LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
LABELS = list(LANGUAGES.values())
MODEL = "table-annotator"
TASK = "Name the language of the text."
CLASSES = 10  # of the vectors
ACCURACY_FLOOR = 0.9
VARIANTS = {
    "english": [[], [("the", "that"), ("on", "off")], [("and", "or"), ("is", "was")]],
    "french": [[], [("le", "la"), ("des", "les")], [("un", "une"), ("qui", "que")]],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, label`` with the language name as label."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", map_values(F.col("lang"), LANGUAGES).alias("label")
    )


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label`` alone: the texts are not read."""
    return documents(spark, sf_dir).select("id", "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"), F.col("label").alias("y")
    )


def reply(row_id: Column, label: Column) -> Column:
    """A reply to the row's text: right, decorated, misspelt, wrong or useless, by id."""
    wrong = F.when(label == "english", F.lit("french")).otherwise(F.lit("english"))
    forms = [
        F.concat(label, F.lit(",0.95")),
        F.concat(F.upper(label), F.lit(" , 95%")),
        F.concat(F.substring(label, 1, 2), F.substring(label, 4, 20), F.lit(",0.8")),
        label,
        F.concat(F.lit("I say "), label, F.lit(" 0.8")),
        F.concat(F.lit("not "), label),
        F.concat(label, F.lit(",0")),
        F.concat(label, F.lit(",-0.5")),
        F.concat(label, F.lit(",nan")),
        F.concat(label, F.lit(",")),
        F.lit("klingon,0.7"),
        F.concat(wrong, F.lit(",0.9,sure")),
    ]
    return F.get(F.array(*forms), (row_id % len(forms)).cast("int"))


def replied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their parsed replies."""
    rows = document_labels(spark, sf_dir)
    return read_replies(rows.withColumn("response", reply(F.col("id"), F.col("label"))), LABELS)


def with_logits(rows: DataFrame) -> DataFrame:
    """Add ``logits``, the negative squared distances to the means of the classes, and ``far``, the plain ones."""
    parts = rows.select("y", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("y", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    found = means.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("mean")).collect()
    tables = [np.array([[s["x"] for s in r["mean"]]]) for r in sorted(found, key=lambda r: r["y"])]
    away = diversity.class_distances(F.col("embedding"), tables)
    return rows.withColumn("_d", away).select(
        *rows.columns, F.transform("_d", lambda d: -d * d).alias("logits"), F.transform("_d", lambda d: -d).alias("far")
    )


def r6(c: Column) -> Column:
    return F.round(c, 6)


# Rows as text, replies, labels


def q_row_as_text(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns(
        {
            "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
            "o_orderpriority": F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_orderpriority")),
        }
    )
    chosen = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    return orders.select(
        "o_orderkey",
        row_as_text(orders).alias("row_text"),
        row_as_text(orders, chosen, exclude_empty=False).alias("full_text"),
    )


def q_response_parse(spark, sf_dir):
    return replied(spark, sf_dir).select(F.col("id").alias("doc_id"), "response", "raw_label", "confidence")


def q_label_match(spark, sf_dir):
    return replied(spark, sf_dir).select(F.col("id").alias("doc_id"), "raw_label", "matched_label")


def q_label_match_table(spark, sf_dir):
    """Misspelt descriptions of parts matched with the table of all descriptions."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("label"))
    labels = parts.groupBy("label").agg(F.min("p_partkey").alias("position"))
    x, at, n = F.col("label"), F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 6

    def changed(length: int, by: str) -> Column:
        return F.concat(F.substring(x, F.lit(1), at), F.lit(by), F.substring(x, at + 1 + length, F.lit(99)))

    raw = F.coalesce(
        F.when(n == 0, F.concat(F.lit(" "), F.upper(x))),
        F.when(n == 1, changed(1, "")),
        F.when(n == 2, changed(2, "")),
        F.when(n == 3, changed(1, "qz")),
        F.when(n == 4, changed(3, "qqq")),
        F.lit("nothing of the kind"),
    )
    rows = label_index.match_labels(parts.select("p_partkey", raw.alias("raw_label")), labels, row_id="p_partkey")
    return rows.select("p_partkey", "raw_label", "matched_label")


def q_confidence_score(spark, sf_dir):
    return replied(spark, sf_dir).groupBy("matched_label", "confidence_score").agg(F.count(F.lit(1)).alias("n"))


def q_label_accuracy(spark, sf_dir):
    """How many texts per matched label and quality, and how accurate."""
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    # Documents are joined before their replies are read: fewer than half of them have a label.
    rows = document_labels(spark, sf_dir).join(truth, "id")
    joined = read_replies(rows.withColumn("response", reply(F.col("id"), F.col("label"))), LABELS)
    return joined.groupBy("matched_label", "quality").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("matched_label") == F.col("label")).alias("correct"),
        r6(metrics.accuracy_of(F.col("matched_label"), F.col("label"))).alias("accuracy"),
        r6(F.avg("confidence_score")).alias("avg_score"),
    )


def q_label_confusion(spark, sf_dir):
    return metrics.confusion(replied(spark, sf_dir), "matched_label", "label")


def q_prediction_report(spark, sf_dir):
    rows = sampling.head(documents(spark, sf_dir), metrics.PREVIEW_ROWS)  # the rest is never read
    read = read_replies(rows.withColumn("response", reply(F.col("id"), F.col("label"))), LABELS)
    return metrics.prediction_report(read, predicted="matched_label")


def q_empty_accuracy(spark, sf_dir):
    """Accuracy of calling every document English: over all of them, and over those of a language there is none of."""
    guessed = document_labels(spark, sf_dir).withColumn("predicted_label", F.lit("english"))
    parts = [("all", guessed), ("none", guessed.where(F.col("label") == "klingon"))]
    found = [metrics.accuracy(rows).select(F.lit(name).alias("rows"), "total", "correct", r6(F.col("accuracy")).alias("accuracy")) for name, rows in parts]
    return corpora.union_splits(*found)


def q_present_labels(spark, sf_dir):
    """Languages that the toxic documents have, of those there are, with their place in the list."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    names = ann.present_labels(document_labels(spark, sf_dir).join(toxic, "id", "left_semi"), LABELS)
    return spark.createDataFrame([(name, LABELS.index(name)) for name in names], "label string, place int")


def q_label_encode(spark, sf_dir):
    index = encode_label(F.col("label"), LABELS)
    rows = document_labels(spark, sf_dir).withColumn("label_index", index)
    hot = F.transform(one_hot(F.col("label_index"), len(LABELS)), lambda x: x.cast("int").cast("string"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "label_index",
        decode_label(F.col("label_index"), LABELS).alias("decoded"),
        F.array_join(hot, "").alias("one_hot"),
    )


def q_class_sizes(spark, sf_dir):
    return sampling.class_sizes(document_labels(spark, sf_dir))


def q_token_cut(spark, sf_dir):
    words = tokens(F.col("text"))
    rows = spread(documents(spark, sf_dir).select("id", "text")).withColumn("words", words)
    kept = head_tokens(F.col("words"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("words").alias("n_tokens"),
        F.size(kept).alias("n_kept"),
        F.md5(F.array_join(kept, " ")).alias("kept_md5"),
    )


# Cache and annotation


def _written(spark, sf_dir) -> DataFrame:
    """Cache rows for about 60 % of the documents, a tenth of them without a reply."""
    rows = documents(spark, sf_dir).where(uniform(1, F.col("id")) < 0.6)
    response = F.when(uniform(2, F.col("id")) < 0.1, F.lit("")).otherwise(reply(F.col("id"), F.col("label")))
    written = rows.select("id", F.col("text").alias("question"), response.alias("response"))
    return replies_cache.cache_rows(written, MODEL, F.col("id"))


def _job(spark, sf_dir) -> ann.Annotations:
    """All documents through the annotation job: a part-filled cache, a prompt with demonstrations, and
    a service whose requests fail or stay away now and then."""
    cache = replies_cache.ResponseCache(spark, new_run_dir(spark, "cache"))
    cache.put(_written(spark, sf_dir))
    rows = documents(spark, sf_dir)
    first = rows.groupBy(text_key(F.col("text")).alias("text_hash")).agg(F.min(F.struct("id", "label")).alias("f"))
    answers = first.select("text_hash", reply(F.col("f.id"), F.col("f.label")).alias("response"))

    def ask(requests, prompt):
        sent = requests.where(uniform(5, F.col("custom_id")) >= 0.05)
        keyed = sent.select("custom_id", text_key(F.col("text")).alias("text_hash"))
        failed = uniform(4, F.col("custom_id")) < 0.1
        return ann.reply_lookup(answers, "text_hash")(keyed, prompt).select(
            "custom_id", F.when(failed, "errored").otherwise(F.col("status")).alias("status"), "response"
        )

    prompt = ann.build_prompt(_demonstrations(spark, sf_dir), LABELS, TASK)
    return ann.annotate(rows.select("id", "text"), prompt, LABELS, ask, MODEL, cache)


def q_cache_key(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select(F.col("id").alias("doc_id"), cache_key(F.col("text"), MODEL).alias("hash_key"))


def q_cache_split(spark, sf_dir):
    """Replies that the cache had, by document."""
    cache = replies_cache.ResponseCache(spark, new_run_dir(spark, "cache"))
    cache.put(_written(spark, sf_dir))
    keyed = ann.keyed_texts(documents(spark, sf_dir), MODEL).select("id", "hash_key")
    hits = read_replies(cache.lookup(keyed), LABELS).select("hash_key", F.lit(True).alias("hit"), "raw_label")
    rows = fan_out_join(keyed, hits, "hash_key", "id", "left")
    return rows.select(F.col("id").alias("doc_id"), F.coalesce("hit", F.lit(False)).alias("hit"), "raw_label")


def q_cache_counters(spark, sf_dir):
    return _job(spark, sf_dir).counters


def q_cache_upsert(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("question"),
        F.col("text").alias("response"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
        "conv_id",
    )
    keyed = turns.select("conv_id", "ts", "response", F.concat_ws(" ", "question", (F.col("conv_id") % 50)).alias("question"))
    late = uniform(3, F.col("conv_id")) >= 0.5
    old = replies_cache.cache_rows(keyed.where(~late), MODEL, F.col("ts"))
    new = replies_cache.cache_rows(keyed.where(late), MODEL, F.col("ts"))
    return replies_cache.upsert(old, new)


def q_annotate_requests(spark, sf_dir):
    keyed = ann.keyed_texts(documents(spark, sf_dir).select("id", "text"), MODEL)
    requests = ann.build_requests(ann.distinct_texts(keyed), MODEL)
    return requests.select("custom_id", "batch", "hash_key", F.md5("content").alias("content_md5"), "model", "max_tokens")


def _demonstrations(spark, sf_dir, k=3) -> DataFrame:
    return sampling.random_per_class(documents(spark, sf_dir), k)


def q_prompt_block(spark, sf_dir):
    examples = ann.example_block(_demonstrations(spark, sf_dir))
    return examples.select(F.lit(ann.system_prompt(LABELS)).alias("system"), "examples")


def q_annotation_job(spark, sf_dir):
    return _job(spark, sf_dir).results.select(
        F.col("id").alias("doc_id"),
        F.md5("text").alias("text_md5"),
        "cached",
        "raw_label",
        "matched_label",
        "confidence",
        "confidence_score",
    )


def q_reply_outcomes(spark, sf_dir):
    """Requests of a batch service that failed or were never answered."""
    rejects = _job(spark, sf_dir).rejects
    return rejects.select("custom_id", "status", F.md5("text").alias("text_md5"))


def q_batch_retries(spark, sf_dir):
    """Batches of all distinct texts, sent up to three times to a service that fails on requests and on whole batches."""
    rows = documents(spark, sf_dir)

    def ask(requests, prompt):
        attempt = F.col("attempt")
        sent = requests.where(uniform(5, attempt, F.col("custom_id")) >= 0.05)
        failed = (uniform(8, attempt, F.col("batch")) < 0.2) | (uniform(4, attempt, F.col("custom_id")) < 0.1)
        return sent.select(
            "custom_id",
            F.when(failed, "errored").otherwise("succeeded").alias("status"),
            F.when(~failed, F.concat(F.lit(LABELS[0] + ",0."), attempt)).alias("response"),
        )

    prompt = ann.Prompt(ann.system_prompt(LABELS), TASK)
    job = ann.annotate(rows.select("id", "text"), prompt, LABELS, ask, MODEL, attempts=3)
    return job.ledger.select("attempt", "batch", "asked", "answered", "failed")


def q_task_prompt(spark, sf_dir):
    """The part of a request that follows the system prompt."""
    prompt = ann.build_prompt(_demonstrations(spark, sf_dir), LABELS, TASK)
    return _demonstrations(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.lit(prompt.task).alias("task"))


def q_annotation_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id"), F.col("event_id").alias("round"), F.col("event_type").alias("label")
    )
    return replies_cache.last_write(events, "user_id", ["round"], ["label"])


def _annotated(spark, sf_dir) -> DataFrame:
    """Annotations of the texts that the labels table covers, the last document's label winning."""
    covered = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    rows = documents(spark, sf_dir).join(covered, "id", "left_semi")
    return latest_annotations(rows.select(text_key(F.col("text")).alias("text_hash"), F.col("id").alias("round"), "label"))


def _corpus(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("id", "text", text_key(F.col("text")).alias("text_hash"))


def q_pending_texts(spark, sf_dir):
    return pending_texts(_corpus(spark, sf_dir), _annotated(spark, sf_dir)).select(F.col("id").alias("doc_id"), "text_hash")


def q_training_rows(spark, sf_dir):
    rows = training_rows(_corpus(spark, sf_dir), _annotated(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"), "label")


# Sampling, order, selection


def q_class_cap(spark, sf_dir):
    return sampling.cap_per_class(document_labels(spark, sf_dir), 100).select(F.col("id").alias("doc_id"), "label")


def q_stratified_split(spark, sf_dir):
    train, validation = sampling.stratified_split(document_labels(spark, sf_dir))
    both = train.withColumn("part", F.lit("train")).unionByName(validation.withColumn("part", F.lit("validation")))
    return both.select(F.col("id").alias("doc_id"), "label", "part")


def q_corpus_load(spark, sf_dir):
    """Two splits in two coded classes, capped, named and split again."""
    coded = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        "text",
        F.when(F.col("lang") == "fr", F.lit(0)).when(F.col("lang") == "en", F.lit(1)).otherwise(F.lit(-1)).alias("label"),
    )
    odd = F.col("source").isin(*[f"src{i}" for i in range(10)])
    splits = [coded.where(odd).drop("source"), coded.where(~odd).drop("source")]
    train, validation = corpora.load_corpus(splits, max_samples=120)
    both = train.withColumn("part", F.lit("train")).unionByName(validation.withColumn("part", F.lit("validation")))
    return both.select(F.col("id").alias("doc_id"), "text", "label", "part")


def q_random_k(spark, sf_dir):
    return sampling.random_per_class(document_labels(spark, sf_dir), 5, seed=7).select(F.col("id").alias("doc_id"), "label")


def q_confident_k(spark, sf_dir):
    scored = with_logits(vectors(spark, sf_dir)).select("id", "label", F.get(softmax(F.col("logits")), F.col("y")).alias("confidence"))
    best = sampling.most_confident_per_class(scored, 5)
    return best.select("label", F.col("id").alias("vec_id"), r6(F.col("confidence")).alias("confidence"), "rank")


def q_dense_position(spark, sf_dir):
    placed = sampling.dense_position(table(spark, sf_dir, "orders"), "o_orderkey")
    return placed.select("o_orderkey", "position", F.floor(F.col("position") / F.lit(100)).alias("batch"))


def q_seeded_shuffle(spark, sf_dir):
    shuffled = sampling.seeded_shuffle(document_labels(spark, sf_dir))
    return shuffled.select(F.col("id").alias("doc_id"), order_key(42, F.col("id")).alias("place"))


def q_head_rows(spark, sf_dir):
    return sampling.head(documents(spark, sf_dir), 150).select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"))


def _first_vectors(spark, sf_dir, k: int) -> dict[str, np.ndarray]:
    """``k`` starting centres per class: the first rows in seeded order (few, since classes are)."""
    starts = sampling.random_per_class(vectors(spark, sf_dir), k, seed=11)
    rows = starts.select("label", order_key(11, F.col("id")).alias("place"), "embedding").collect()
    found: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["label"], r["place"])):
        found.setdefault(row["label"], []).append(row["embedding"])
    return {name: np.array(rows) for name, rows in found.items()}


def q_nearest_centroid(spark, sf_dir):
    centres = np.concatenate([c for _, c in sorted(_first_vectors(spark, sf_dir, 1).items())])
    near = diversity.nearest_centre(F.col("embedding"), centres).alias("near")
    return vectors(spark, sf_dir).select("id", near).select(
        F.col("id").alias("vec_id"), "near.cluster", r6(F.col("near.distance")).alias("distance")
    )


def q_medoids_fixed_start(spark, sf_dir):
    centres = _first_vectors(spark, sf_dir, 4)
    near = diversity.nearest_centre_of_class(F.col("label"), F.col("embedding"), centres).alias("near")
    assigned = vectors(spark, sf_dir).select("id", "label", near).select("id", "label", "near.cluster", "near.distance")
    found = diversity.medoids(assigned)
    return found.select("label", "cluster", F.col("id").alias("vec_id"), r6(F.col("distance")).alias("distance"))


def q_nearest_demo_annotate(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    demos = sampling.random_per_class(rows, 3, seed=5)
    replies = ann.nearest_demo_replies(rows, demos, [str(i) for i in range(10)])
    return replies.select(F.col("id").alias("vec_id"), "response")


def q_diverse_demos(spark, sf_dir):
    chosen = diversity.select_diverse(vectors(spark, sf_dir).drop("y"), 10)
    return chosen.select(F.col("id").alias("vec_id"), "label")


def q_clean_diverse_demos(spark, sf_dir):
    """Loss mixture over all vectors, clean ones kept, medoids of each class among them."""
    rows = vectors(spark, sf_dir)
    rows = with_logits(rows).withColumn("loss", cross_entropy(softmax(F.col("logits")), F.col("y")))
    chosen = diversity.select_diverse_clean(rows.drop("y", "logits", "far"), 5)
    return chosen.select(F.col("id").alias("vec_id"), "label")


def q_pooled_embedding(spark, sf_dir):
    """Pooled token vectors of all documents, each by some of its numbers and sums over all of them."""
    rows = documents(spark, sf_dir).select("id", "text")
    pooled = fit_pooler(rows).transform(spread(rows))
    e = F.transform("embedding", lambda x: x.cast("double"))
    placed = F.transform(e, lambda x, i: x * (i + 1))
    return pooled.select(
        F.col("id").alias("doc_id"),
        F.size("embedding").alias("width"),
        *(r6(F.get(e, F.lit(i))).alias(f"e{i}") for i in (0, 63, 127)),
        r6(array_total(F.transform(e, lambda x: x * x))).alias("squared"),
        r6(array_total(placed)).alias("placed"),
    )


# Losses, mixture, augmentation


def q_loss_softmax(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    scored = with_logits(rows).select("id", "y", softmax(F.col("logits")).alias("p"))
    return scored.select(
        F.col("id").alias("vec_id"),
        argmax(F.col("p")).alias("predicted"),
        argmin(F.col("p")).alias("least"),
        r6(F.array_max("p")).alias("confidence"),
        r6(cross_entropy(F.col("p"), F.col("y"))).alias("loss"),
    )


def q_soft_ce_kl(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    pair = with_logits(rows).select(
        "id", softmax(F.col("logits")).alias("t"), log_softmax(F.col("far")).alias("ls"), "embedding"
    )
    return pair.select(
        F.col("id").alias("vec_id"),
        r6(soft_cross_entropy(F.col("t"), F.col("ls"))).alias("soft_ce"),
        r6(kl_divergence(F.col("t"), F.col("ls"))).alias("kl"),
        r6(distance(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("halves"),
    )


def q_gmm_clean(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("loss"))
    flagged = noise.flag_clean(events)
    return flagged.select("event_id", r6(F.col("prob")).alias("prob"), "clean")


def q_gmm_summary(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    losses = with_logits(rows).select("label", cross_entropy(softmax(F.col("logits")), F.col("y")).alias("loss"))
    mixture = noise.fit_loss_mixture(losses)
    flagged = noise.flag_clean(losses, mixture=mixture)
    return flagged.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("clean").alias("n_clean"),
        r6(F.avg("prob")).alias("avg_prob"),
        F.lit(round(mixture.means[0], 6)).alias("clean_mean"),
        F.lit(round(mixture.means[1], 6)).alias("noisy_mean"),
    )


def q_clean_lookup(spark, sf_dir):
    """Training rows whose flag table calls them clean; documents without a flag are not."""
    flags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("clean"))
    kept = noise.lookup_clean(document_labels(spark, sf_dir), flags)
    return kept.select(F.col("id").alias("doc_id"), "label")


def q_word_drop(spark, sf_dir):
    rows = spread(documents(spark, sf_dir).select("id", "text"))
    dropped = rows.select("id", drop_words(F.col("text"), F.col("id")).alias("dropped"))
    return dropped.select(
        F.col("id").alias("doc_id"), F.md5("dropped").alias("dropped_md5"), F.length("dropped").cast("long").alias("n_chars")
    )


def q_mangle(spark, sf_dir):
    rows = spread(documents(spark, sf_dir).select("id", "text"))
    mangled = rows.select("id", mangle(F.col("text"), F.col("id")).alias("mangled"))
    return mangled.select(
        F.col("id").alias("doc_id"), F.md5("mangled").alias("mangled_md5"), F.length("mangled").cast("long").alias("n_chars")
    )


def q_corpus_expand(spark, sf_dir):
    rows = expand_corpus(documents(spark, sf_dir), VARIANTS)
    return rows.select(F.col("id").alias("doc_id"), "variant", "label", F.md5("text").alias("text_md5"))


def q_mixup_pairs(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    numbers = rows.select("id", "y", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    mixed = mixup(numbers.withColumn("target", one_hot(F.col("y"), CLASSES)), groups=4)
    return mixed.select(
        F.col("id").alias("vec_id"),
        "partner_id",
        r6(F.col("lam")).alias("lam"),
        r6(array_total(F.col("mixed_vector"))).alias("vector_sum"),
        r6(F.get("mixed_target", F.col("y"))).alias("own_share"),
        r6(array_total(F.col("mixed_target"))).alias("target_sum"),
    )


# Rounds and losses over stages


def q_convergence(spark, sf_dir):
    monthly = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("round")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("val_accuracy")
    )
    gained = metrics.with_gain(monthly)
    return gained.select("round", r6(F.col("val_accuracy")).alias("val_accuracy"), r6(F.col("gain")).alias("gain"), "stop")


def _stage_losses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("stage"), F.col("l_orderkey").alias("id"), F.col("l_discount").alias("loss")
    )


def q_mean_loss_per_stage(spark, sf_dir):
    means = metrics.mean_loss_per_stage(_stage_losses(spark, sf_dir))
    return means.select("stage", r6(F.col("avg_loss")).alias("avg_loss"))


def q_loss_history(spark, sf_dir):
    history = metrics.loss_history(_stage_losses(spark, sf_dir))
    shown = F.transform("losses", lambda x: F.format_string("%.2f", x))
    return history.select(F.col("id").alias("l_orderkey"), F.array_join(shown, ";").alias("losses"))


# Files written and read back


def q_csv_roundtrip(spark, sf_dir):
    path = new_run_dir(spark, "csv")
    corpora.write_csv(documents(spark, sf_dir), path)
    back = corpora.read_samples_csv(spark, path, "id long, text string, label string")
    return back.select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"), "label")


def q_demonstrations_roundtrip(spark, sf_dir):
    path = new_run_dir(spark, "demos")
    corpora.write_demonstrations(_demonstrations(spark, sf_dir), path)
    back = corpora.read_demonstrations(spark, path)
    return back.select(F.col("id").alias("position"), F.md5("text").alias("text_md5"), "label")


def q_cache_roundtrip(spark, sf_dir):
    """Two writes of the same keys to a cache folder, then a read: the second one's replies count."""
    cache = replies_cache.ResponseCache(spark, new_run_dir(spark, "cache"))
    rows = documents(spark, sf_dir).select("id", F.col("text").alias("question"), reply(F.col("id"), F.col("label")).alias("response"))
    cache.put(replies_cache.cache_rows(rows.withColumn("response", F.lit("old")), MODEL, F.lit(0)))
    cache.put(replies_cache.cache_rows(rows, MODEL, F.col("id") + 1))
    return cache.compact(new_run_dir(spark, "cache")).read().select("hash_key", "response", "timestamp")


def q_cache_point_lookup(spark, sf_dir):
    """Cached replies to the documents marked toxic, from a cache of all documents' replies that was compacted between two writes."""
    cache = replies_cache.ResponseCache(spark, new_run_dir(spark, "cache"))
    rows = documents(spark, sf_dir).select("id", F.col("text").alias("question"), reply(F.col("id"), F.col("label")).alias("response"))
    cache.put(replies_cache.cache_rows(rows.withColumn("response", F.lit("old")), MODEL, F.lit(0)))
    cache.compact()
    cache.put(replies_cache.cache_rows(rows, MODEL, F.col("id") + 1))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    keys = rows.join(toxic, "id", "left_semi").select(cache_key(F.col("question"), MODEL).alias("hash_key"))
    return cache.lookup(keys).select("hash_key", "response")


# Training, prediction, the loop


def _noisy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    train, validation = sampling.stratified_split(documents(spark, sf_dir))
    wrong = F.when(F.col("label") == "english", F.lit("french")).otherwise(F.lit("english"))
    return train.withColumn("label", F.when(uniform(9, F.col("id")) < 0.1, wrong).otherwise(F.col("label"))), validation


def q_robust_train_eval(spark, sf_dir):
    """Stages of the robust classifier on noisy language labels, and what must hold of each: every
    row has a finite loss, the fit converged, held-out accuracy reaches its floor, and the flags of
    the last stage are mostly right about which labels are wrong."""
    train, validation = _noisy(spark, sf_dir)
    model, stats = train_robust(spread(train), LABELS, spread(validation), stages=3)
    truth = documents(spark, sf_dir).select("id", F.col("label").alias("truth"))
    flags = stats.samples.join(truth, "id").select("clean", (F.col("label") == F.col("truth")).alias("right"))
    counted = flags.agg(
        F.count_if(F.col("clean") & F.col("right")) / F.count_if("clean"), F.count_if(~F.col("clean") & ~F.col("right")) / F.count_if(~F.col("right"))
    ).first()
    stages = [
        (i, bool(done), bool(a >= ACCURACY_FLOOR), bool(i < 2 or (counted[0] >= 0.9 and counted[1] >= 0.5)))
        for i, (done, a) in enumerate(zip(stats.converged, stats.validation_accuracies, strict=True))
    ]
    facts = spark.createDataFrame(stages, "stage int, converged boolean, accurate boolean, flags_right boolean")
    per = stats.losses.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(noise.finite(F.col("loss"))).alias("finite"))
    return per.join(facts, "stage")


def q_predict_confidence(spark, sf_dir):
    """A classifier of the vectors, saved, loaded and applied to all of them; each row with what must hold of it."""
    rows = vectors(spark, sf_dir).select("id", "embedding", "label")
    names = [str(i) for i in range(CLASSES)]
    model, _ = train_robust(rows, names, stages=3)
    path = new_run_dir(spark, "model")
    model.save(path)
    loaded = Classifier.load(path)
    scored = loaded.predict(rows).join(loaded.probabilities(rows).select("id", "probability"), "id")
    best = decode_label(argmax(F.col("probability")), names)
    total = F.abs(array_total(F.col("probability")) - F.lit(1.0)) < 1e-9
    return scored.select(
        F.col("id").alias("vec_id"),
        "label",
        (F.col("predicted_label") == best).alias("is_argmax"),
        ((F.col("confidence") == F.array_max("probability")) & (F.col("confidence") >= 1 / CLASSES) & total).alias("in_range"),
    )


def q_vector_predictions(spark, sf_dir):
    """Label and confidence that a classifier learned from the vectors gives each of them."""
    rows = vectors(spark, sf_dir).select("id", "embedding", "label")
    model, _ = train_robust(rows, [str(i) for i in range(CLASSES)], stages=3)
    return model.predict(rows).select(F.col("id").alias("vec_id"), "label", "predicted_label", r6(F.col("confidence")).alias("confidence"))


def q_examples_by_strategy(spark, sf_dir):
    """Examples per class by each strategy; the confident ones by a model's own confidence in the rows."""
    rows = vectors(spark, sf_dir).select("id", "embedding", "label")
    model, _ = train_robust(rows, [str(i) for i in range(CLASSES)], stages=3)
    scored = model.own_confidence(rows)
    chosen = [
        diversity.select_examples(scored, 5, s).select(F.lit(s).alias("strategy"), "id", "label")
        for s in ("diverse", "random", "confident")
    ]
    marked = corpora.union_splits(*chosen).join(scored.select("id", "confidence"), "id")
    least = marked.groupBy("strategy", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    # No more rows of the class are as confident as the least chosen one than were chosen.
    above = scored.join(least.where("strategy = 'confident'"), "label").groupBy("label").agg(
        (F.count_if(F.col("confidence") > F.col("least")) < F.any_value("n")).alias("top")
    )
    listed = F.when(F.col("strategy") != "confident", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    return least.join(above, "label").select(
        "strategy", "label", "n", listed.alias("vec_ids"), ((F.col("strategy") != "confident") | F.col("top")).alias("holds")
    )


def q_label_loop(spark, sf_dir):
    """The loop with its defaults from five demonstrations per language, asking again each round, and
    what must hold of it: every text annotated, a full pool each round, and an accuracy of at least
    90 % of that of the same classifier on the true labels."""
    train, validation = sampling.stratified_split(documents(spark, sf_dir))
    train, validation = spread(train), spread(validation)
    demos = sampling.random_per_class(train, 5)
    result = label_loop(train.select("id", "text"), demos, LABELS, TASK, validation=validation, reannotate=True)
    # The loop's encoder weighs words by the same texts.
    supervised, _ = train_robust(train, LABELS, stages=1, encoder=result.model.encoder)
    share = result.final_accuracy / supervised.evaluate(validation)
    return result.metrics.agg(
        F.min("annotation_count").alias("least_annotated"),
        F.max("annotation_count").alias("most_annotated"),
        F.min("demo_pool_size").alias("least_pool"),
        F.max("demo_pool_size").alias("most_pool"),
        (F.max("round").between(2, 4) & (F.max("round") == F.count(F.lit(1)))).alias("rounds_in_range"),
        (F.lit(share) >= 0.9).alias("near_supervised"),
    )


def named() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}

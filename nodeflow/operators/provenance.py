"""From nodes back to texts: pointers, datasets and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeflow.functions import texts as X


def known_pointers(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pointers with both ids set and a node that exists."""
    return new.where("node_id <> '' and source_id <> ''").join(
        nodes.select("node_id"), "node_id", "left_semi").select("node_id", "source_id")


def pointer_insert(pointers: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add new(node_id, source_id); known pairs and unknown nodes are left out."""
    return pointers.select("node_id", "source_id").unionByName(known_pointers(new, nodes)).distinct()


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "node_id") -> dict[str, DataFrame]:
    """Drop deleted(key) from every table that carries the key."""
    gone = deleted.select(key).distinct()
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def latest_by(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key. One struct per key is aggregated before the shuffle, so a hot key is no burden."""
    rest = [c for c in table.columns if c not in keys]
    picked = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def session_replace(sessions: DataFrame) -> DataFrame:
    return latest_by(sessions, ["session_id"], [F.col("created_timestamp"), F.col("dataset_name")])


def _contained(ids: DataFrame, datasets: DataFrame) -> DataFrame:
    """(source_id, _contained): first dataset whose name is part of the id, ignoring case.

    An equi-join on the parts of the id that are as long as some name.
    """
    named = datasets.select(F.lower("dataset_name").alias("_part"), "dataset_name", "dataset_order")
    lengths = [r[0] for r in named.select(F.length("_part")).distinct().collect()]  # a few lengths of names
    low = F.lower("source_id")
    none = F.array().cast("array<string>")

    def cut_out(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (n - 1))
        return F.when(F.length(low) >= n, F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))).otherwise(none)

    parts = F.flatten(F.array(*([cut_out(n) for n in lengths] or [none])))
    exploded = ids.where("source_id IS NOT NULL").select("source_id").distinct().select(
        "source_id", F.explode(F.array_distinct(parts)).alias("_part"))
    first = F.struct(F.col("dataset_order").isNull(), "dataset_order", "dataset_name")
    return exploded.join(named, "_part").groupBy("source_id").agg(F.min_by("dataset_name", first).alias("_contained"))


def _named_in(datasets: DataFrame, low: Column) -> Column:
    """First dataset whose name is part of ``low``, which is in lower case: one pass of an Aho-Corasick automaton
    over each value. The names travel with the tasks, each of which builds the automaton once."""
    ordered = datasets.orderBy(F.col("dataset_order").isNull(), "dataset_order", "dataset_name")
    names = [tuple(r) for r in ordered.select(F.lower("dataset_name"), "dataset_name").collect()]

    @F.pandas_udf("string")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places = {}
        for place, (part, _) in enumerate(names):
            places.setdefault(part, place)
        everywhere = places.pop("", len(names))  # an empty name is part of every id
        machine = ahocorasick.Automaton()
        for part, place in places.items():
            machine.add_word(part, place)
        machine.make_automaton()

        def search(text: str | None) -> str | None:
            if not isinstance(text, str):
                return None
            hits = [place for _, place in machine.iter(text)] if places else []
            place = min([everywhere, *hits])
            return names[place][1] if place < len(names) else None

        for batch in batches:
            yield pd.Series([search(text) for text in batch], dtype=object)

    return first(low)


def resolve_dataset(sources: DataFrame, datasets: DataFrame, sessions: DataFrame, automaton_bytes: int = 1_000_000) -> DataFrame:
    """sources(source_id), datasets(dataset_name, dataset_order), sessions(session_id, dataset_name) -> + dataset.

    Order: known prefix, session, a dataset name contained in the id, the only dataset. Every source row
    stays once. A repeated name counts once with its smallest order; equal orders go by name, null orders
    come last, null names do not count; of several rows of a session the smallest name is taken.

    Names of up to ``automaton_bytes`` bytes together are searched by an automaton (about 40 bytes of memory for
    each in every Python worker), and only in ids that neither prefix nor session resolves. Beyond that the parts
    of the ids are joined with the names.
    """
    known = datasets.where("dataset_name IS NOT NULL").groupBy("dataset_name").agg(F.min("dataset_order").alias("dataset_order"))
    stats = known.agg(F.count("*"), F.max("dataset_name"), F.sum(F.octet_length("dataset_name"))).first()
    only = F.lit(stats[1] if stats[0] == 1 else None).cast("string")
    session = sessions.groupBy("session_id").agg(F.min("dataset_name").alias("_session_dataset")).withColumnRenamed("session_id", "_prefix")
    exact = known.select(F.col("dataset_name").alias("_prefix"), F.col("dataset_name").alias("_exact"))
    by_prefix = exact.join(session, "_prefix", "full")
    # ids without a prefix get a key of their own, so they do not meet in one task
    key = F.coalesce(X.prefix(F.col("source_id")), F.concat(F.lit("\0"), "source_id"))
    found = sources.withColumn("_prefix", key).join(by_prefix, "_prefix", "left")
    if (stats[2] or 0) <= automaton_bytes:
        still_open = F.when(F.coalesce("_exact", "_session_dataset").isNull(), F.lower("source_id"))
        found = found.withColumn("_contained", _named_in(known, still_open))
    else:
        found = found.join(_contained(sources, known), "source_id", "left")
    found = found.withColumn("dataset", F.coalesce("_exact", "_session_dataset", "_contained", only))
    return found.select(*sources.columns, "dataset")


def resolve_texts(pointers: DataFrame, texts: DataFrame) -> DataFrame:
    """pointers(node_id, source_id, dataset, ...) with texts(dataset, source_key, text): text or null, pointer kept."""
    keyed = pointers.withColumn("source_key", X.local_part(F.col("source_id")))
    return keyed.join(texts.select("dataset", "source_key", "text"), ["dataset", "source_key"], "left")


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("node_id").agg(
        F.count("*").alias("n_pointers"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("n_texts"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_failed"))


def provenance_counts(resolved: DataFrame) -> DataFrame:
    """Texts per node and dataset and the share of the node they are."""
    counts = resolved.groupBy("node_id", "dataset").agg(F.count("*").alias("n_sources"))
    total = F.sum("n_sources").over(W.partitionBy("node_id"))
    return counts.withColumn("share", F.col("n_sources") / total)


def recent(table: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Last n rows per key by ``order`` (descending columns).

    Spark applies the rank limit inside every partition before the shuffle (window group
    limit), so a hot key sends at most n rows per partition over the network.
    """
    return table.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(
        F.col("_rn") <= n).drop("_rn")


def label_update(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node_id, new_label) overwrite the label of their node; of several the latest by ``at`` if
    they carry it, then the larger. Null labels change nothing."""
    newest = F.struct(*(["at"] if "at" in labels.columns else []), "new_label")
    labels = labels.where("new_label IS NOT NULL").groupBy("node_id").agg(F.max(newest).alias("u")).select("node_id", F.col("u.new_label").alias("new_label"))
    return nodes.join(labels, "node_id", "left").withColumn(
        "label", F.coalesce("new_label", "label")).drop("new_label")

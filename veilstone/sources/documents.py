"""Job documents with fields that this library doesn't know: read by path, changed and written without loss.

A document is one JSON object in a text column. It is held as a map of its top-level fields to variants, so
unknown ones, of any shape, travel along; a document that a change doesn't concern keeps its very text. In one
that changes, numbers keep their value, not their spelling (1.50 becomes 1.5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """(dir, doc) of each job.json in the folders below ``path``: the folder's name and the whole text."""
    raw = spark.read.text(f"{path}/*/job.json", wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dir"), F.col("value").alias("doc"))


def _parsed(doc: Column) -> Column:
    """A text as a variant, null if it isn't one JSON value from end to end: the parser itself stops behind the
    first value, so the text is read as a field that another one follows."""
    framed = F.try_parse_json(F.concat(F.lit('{"doc":'), doc, F.lit(',"__end":0}')))
    both = F.try_variant_get(framed, "$", "map<string,variant>")
    return F.when((F.size(both) == 2) & F.map_contains_key(both, "__end"), F.try_element_at(both, F.lit("doc")))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def fields(doc: Column) -> Column:
    """The top-level fields of a document as a map to variants, in their order; null for what isn't one object."""
    return F.when(_is_object(_parsed(doc)), F.from_json(doc, "map<string,variant>"))


def split_documents(raw: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt): rows whose ``doc`` is one JSON object, and all others: null, empty or cut texts, other
    values, texts with something behind the object, and objects with a field twice."""
    sound = fresh("__sound", raw)
    marked = raw.withColumn(sound, _is_object(_parsed(F.col(doc))))
    return marked.filter(sound).drop(sound), marked.filter(~F.col(sound)).drop(sound)


def with_paths(docs: DataFrame, paths: dict[str, tuple[str, str]], doc: str = "doc") -> DataFrame:
    """``docs`` with a column for each of ``paths`` (name: (path, type)), such as ("$.mux.files[0]", "string").
    A path that a document doesn't have, or a value of another type, is null. The text is parsed once."""
    taken = [c for c in paths if c in docs.columns]
    if taken:
        raise ValueError(f"columns exist: {taken}")
    whole = fresh("__whole", docs)
    parsed = docs.withColumn(whole, _parsed(F.col(doc)))
    return parsed.select(*docs.columns, *[F.try_variant_get(whole, path, kind).alias(name) for name, (path, kind) in paths.items()])


def unknown_fields(docs: DataFrame, known: list[str], doc: str = "doc") -> DataFrame:
    """One row for each top-level field not among ``known``: the other columns of ``docs``, field and its value
    as JSON text."""
    held = fields(F.col(doc))
    others = [c for c in docs.columns if c != doc]
    return docs.select(*others, F.explode(F.map_filter(held, lambda k, _: ~k.isin(*known))).alias("field", "value")).select(*others, "field", F.to_json("value").alias("value"))


def put_fields(docs: DataFrame, changes: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """``docs`` with top-level fields set by ``changes`` (``key``, field, value as JSON text; null value: the field
    goes). All other fields stay as they are, in their order, new ones behind them, by name. Documents without a
    change keep their text; changes of unknown documents and texts that aren't JSON do nothing; of several changes
    of one field the greatest text wins, a value before none."""
    sure = changes.filter(F.col("value").isNull() | _parsed(F.col("value")).isNotNull())
    last = sure.groupBy(key, "field").agg(F.max("value").alias("value"))
    new, gone = fresh("__new", docs), fresh("__gone", docs)
    pairs = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value"))))
    per = last.groupBy(key).agg(F.map_from_entries(pairs).alias(new), F.collect_list(F.when(F.col("value").isNull(), F.col("field"))).alias(gone))
    both = docs.join(per, key, "left")
    held = fields(F.col(doc))
    kept = F.map_filter(held, lambda k, _: ~F.array_contains(gone, k))
    same = F.map_from_entries(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"], F.coalesce(F.parse_json(F.try_element_at(new, e["key"])), e["value"]))))
    added = F.map_filter(new, lambda k, _: ~F.map_contains_key(kept, k))
    more = F.map_from_entries(F.transform(F.map_entries(added), lambda e: F.struct(e["key"], F.parse_json(e["value"]))))
    changed = F.to_json(F.map_concat(same, more))
    text = F.when(F.col(new).isNotNull() & held.isNotNull(), changed).otherwise(F.col(doc))
    return both.withColumn(doc, text).select(*docs.columns)


def steps_after(docs: DataFrame, events: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """``docs`` with ``steps_completed`` after done and undo events (``key``, seq, step, action): a step is
    appended if it isn't there, an undone one leaves its place; other actions change nothing. Everything else in
    the documents stays."""
    moves = events.filter(F.col("action").isin("done", "undo"))
    per = moves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "step", F.col("action").alias("act")))).alias("moves"))
    start = F.coalesce(F.try_variant_get(_parsed(F.col(doc)), "$.steps_completed", "array<string>"), F.array().cast("array<string>"))

    def move(done: Column, m: Column) -> Column:
        there = F.array_contains(done, m["step"])
        return F.when((m["act"] == "done") & ~there, F.array_append(done, m["step"])).when(m["act"] == "undo", F.array_remove(done, m["step"])).otherwise(done)

    after = docs.join(per, key).select(key, F.lit("steps_completed").alias("field"), F.to_json(F.aggregate("moves", start, move)).alias("value"))
    return put_fields(docs, after, key, doc)

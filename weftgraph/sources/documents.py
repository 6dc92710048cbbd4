"""Documents to text units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.order import unit_order
from weftgraph.functions.text import count_tokens, stable_document_id, strip, unit_id, window_pieces

TEXT_COLUMNS = ("text", "page_content", "content")
ID_COLUMNS = ("doc_id", "id", "_id")
TITLE_COLUMNS = ("title", "filename")


def coerce_documents(rows: DataFrame, *, text: str | None = None, document_id: str | None = None, order: str | None = None) -> DataFrame:
    """Any table of texts as (id, title, text, metadata, ord): texts trimmed, blank ones dropped.

    The text is the first filled one of text, page_content and content, the id the first of document_id, doc_id, id and _id,
    else made from the text. metadata holds all other columns that can be a string and aren't null, and the id as doc_id.
    Documents go by `order`, by default the id column, where that is a whole number, else by a hash of the id; so ids may be of
    any kind. Rows of one id stay apart here: their texts are units of one document, whose record is that of the first.
    """
    have = set(rows.columns)
    texts = [text] if text else [c for c in TEXT_COLUMNS if c in have]
    ids = [document_id] if document_id else [c for c in ("document_id", *ID_COLUMNS) if c in have]
    titles = [c for c in TITLE_COLUMNS if c in have]
    if not texts:
        raise ValueError("no column holds a text")
    body = F.coalesce(*[F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in texts])
    made = rows.withColumn("_t", body).filter("_t is not null").withColumn("_i", stable_document_id(F.col("_t"), *map(F.col, ids)))
    name = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in titles], F.col("_i"))
    place = F.col(order) if order else F.col(ids[0]) if ids else F.xxhash64("_i")
    numbered = place.try_cast("long") if order or ids else place
    told = {c: F.col(c).cast("string") for c, kind in rows.dtypes if c not in {*texts, "doc_id"} and not kind.startswith(("array", "map", "struct", "binary", "variant"))}
    told["doc_id"] = F.col("_i")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in told.items()]), lambda p: p["value"].isNotNull())
    return made.select(F.col("_i").alias("id"), name.alias("title"), F.col("_t").alias("text"), F.map_from_entries(pairs).alias("metadata"), F.coalesce(numbered, F.xxhash64("_i")).alias("ord"))


def compose_text_units(documents: DataFrame, *, chunk_size: int = 1200, chunk_overlap: int = 100, chunk_enabled: bool = True, max_chunks: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """Windows of the documents' texts: (id, text, document_id, chunk_index, n_tokens, metadata, unit_ord), no shuffle.

    Windows are of characters or, by the ranks at `tokenizer`, of BPE tokens; a text has `max_chunks` at most, if that is given,
    else it is covered whole. unit_ord orders the units of all documents: by the document's ord, then by place.
    """
    pieces = window_pieces(F.col("text"), chunk_size, chunk_overlap, max_chunks, tokenizer) if chunk_enabled else F.array("text")
    meta = F.col("metadata") if "metadata" in documents.columns else F.lit(None).cast("map<string,string>")
    rows = documents.select(F.col("id").alias("document_id"), "ord", meta.alias("metadata"), F.posexplode(pieces).alias("chunk_index", "text"))
    rows = rows.withColumn("id", unit_id(F.col("document_id"), F.col("chunk_index"), F.col("text")))
    own = F.map_from_arrays(F.array(F.lit("doc_id"), F.lit("document_id"), F.lit("chunk_index")), F.array("id", "document_id", F.col("chunk_index").cast("string")))
    others = F.map_filter(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin("doc_id", "document_id", "chunk_index"))
    return rows.select(
        "id",
        "text",
        "document_id",
        "chunk_index",
        count_tokens(F.col("text"), tokenizer).alias("n_tokens"),
        F.map_concat(others, own).alias("metadata"),
        unit_order(F.col("ord"), F.col("chunk_index")).alias("unit_ord"),
    )


def document_records(documents: DataFrame, units: DataFrame) -> DataFrame:
    """The table of documents: first 2000 characters, metadata, and the ids of the units in order; one row for each id."""
    first = F.struct("ord", F.xxhash64("text"))
    columns = [c for c in ("text", "title", "metadata", "ord") if c in documents.columns]
    documents = documents.groupBy("id").agg(F.min_by(F.struct(*columns), first).alias("d")).select("id", "d.*")
    listed = units.groupBy("document_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"])).alias("text_unit_ids"))
    return documents.join(listed, documents["id"] == listed["document_id"]).select("id", F.substring("text", 1, 2000).alias("text"), "title", "text_unit_ids", *[c for c in columns if c in ("metadata", "ord")])


def chunk_stats(units: DataFrame) -> DataFrame:
    return units.agg(
        F.count_distinct("document_id").alias("documents"), F.count("*").alias("text_units"), F.sum("n_tokens").cast("long").alias("tokens"), F.max("n_tokens").cast("long").alias("longest")
    )

"""Readers and writers: content lists, JSON lines, keyed JSON stores, GraphML, CSV sheets and folders."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from spindle.functions.text import file_name, let, suffix_of
from spindle.session import written

BLOCK = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("type", "text")], T.StructField("text_level", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.IntegerType())),
    T.StructField("page_idx", T.IntegerType()), T.StructField("img_path", T.StringType()),
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("image_caption", "img_caption", "image_footnote", "img_footnote", "table_caption", "table_footnote")],
    *[T.StructField(n, T.StringType()) for n in ("table_body", "latex", "content")],
])
#: Keys that GraphML files may declare.
MOST_KEYS = 10_000
#: Suffixes by kind of parser.
SUFFIXES = {"pdf": [".pdf"], "image": [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif", ".webp"], "office": [".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".html", ".htm"], "text": [".txt", ".md"]}


def safe_path(path: Column, base: str) -> Column:
    """A path below base made absolute; empty where it leads outside."""
    p = F.translate(path, "\\", "/")
    return F.when(p.isNull(), F.lit(None)).when(p.rlike(r"(^|/)\.\.(/|$)"), "").when(p.startswith("/"), F.when(p.startswith(base.rstrip("/") + "/"), p).otherwise("")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def read_content_lists(spark: SparkSession, path: str, base: str = "", name: str = "*_content_list.json") -> DataFrame:
    """Blocks of files of that name in any folder below path, each with one JSON array, with file_path and block_idx; both spellings of captions are read."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True).withColumn("file_path", F.col("_metadata.file_path"))
    b = raw.select("file_path", F.posexplode(F.from_json("value", T.ArrayType(BLOCK))).alias("block_idx", "b")).select("file_path", "block_idx", "b.*")
    for kind in ("caption", "footnote"):
        b = b.withColumn(f"image_{kind}", F.coalesce(f"image_{kind}", f"img_{kind}")).drop(f"img_{kind}")
    return b.withColumn("img_path", safe_path(F.col("img_path"), base)) if base else b


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_store(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """Key and value columns of a JSON object of objects."""
    raw = spark.read.text(path, wholetext=True)
    e = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("key", "v"))
    return e.select("key", "v.*") if isinstance(value, T.StructType) else e.withColumnRenamed("v", "value")


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def supported_files(files: DataFrame, suffixes: list[str]) -> DataFrame:
    return files.filter(suffix_of(F.col("path")).isin(*[s.lower() for s in suffixes]))


def read_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files of a folder with the kind of parser they need and a unique output name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")
    kind = F.lit("other")
    for k, s in SUFFIXES.items():
        kind = F.when(suffix_of(F.col("path")).isin(*s), k).otherwise(kind)
    stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]+$", "")
    return f.withColumn("kind", kind).withColumn("output", F.concat(stem, F.lit("_"), F.substring(F.md5("path"), 1, 8)))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (source, target, attributes) of GraphML files; attributes by declared name."""
    kv = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))
    read = lambda tag, fields: spark.read.format("xml").option("rowTag", tag).schema(T.StructType(fields)).load(path)
    s = lambda n: T.StructField(n, T.StringType())
    # declarations, not data: a few for each kind of element
    declared = {r[0]: r[1] for r in read("key", [s("_id"), s("_attr.name")]).select("_id", "`_attr.name`").distinct().limit(MOST_KEYS + 1).collect()}
    if len(declared) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys are declared")
    names = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv]) if declared else F.create_map().cast("map<string,string>")
    data = T.StructField("data", kv)

    def attributes(df: DataFrame) -> DataFrame:
        """Each element by itself, as several edges may join the same nodes; of an attribute given twice the last counts."""
        told = F.transform(F.coalesce("data", F.array().cast(kv)), lambda d: F.struct(F.coalesce(F.try_element_at(names, d["_key"]), d["_key"]).alias("name"), d["_VALUE"].alias("v")))
        told = F.filter(told, lambda x: x["name"].isNotNull() & x["v"].isNotNull())
        last = let(told, lambda t: F.transform(F.array_distinct(F.transform(t, lambda x: x["name"])), lambda n: F.struct(n.alias("name"), F.element_at(F.filter(t, lambda x: x["name"] == n), -1)["v"].alias("v"))))
        return df.withColumn("attributes", F.map_from_entries(last)).drop("data")

    nodes = attributes(read("node", [s("_id"), data]).withColumnRenamed("_id", "id").filter(F.coalesce("id", F.lit("")) != ""))
    # the name that a node gives itself counts before its number
    own = F.trim(F.coalesce(F.try_element_at("attributes", F.lit("entity_id")), F.lit("")))
    nodes = nodes.withColumn("id", F.when(own != "", own).otherwise(F.col("id")))
    edges = attributes(read("edge", [s("_source"), s("_target"), data]).withColumnRenamed("_source", "source").withColumnRenamed("_target", "target"))
    told = lambda k: F.nullif(F.trim(F.try_element_at("attributes", F.lit(k))), F.lit(""))
    return nodes, edges.withColumn("relation_type", F.coalesce(told("relation_type"), told("keywords"), F.lit("")))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, node_fields: list[str], edge_fields: list[str]) -> None:
    """One GraphML file: nodes by id, edges by ends and numbered. A single file is the format, so one task writes it."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda fields, p: F.concat(*[F.concat(F.lit(f'<data key="{p}{i}">'), safe(f), F.lit("</data>")) for i, f in enumerate(fields)])
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for fields, p, what in ((node_fields, "n", "node"), (edge_fields, "e", "edge")):
        head += [f'<key id="{p}{i}" for="{what}" attr.name="{escape(f)}" attr.type="string"/>' for i, f in enumerate(fields)]
    spark = nodes.sparkSession
    first = spark.createDataFrame([(0, i, "", "", x) for i, x in enumerate([*head, '<graph edgedefault="directed">'])], "part int, n long, k string, k2 string, value string")
    n = nodes.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.col("id").alias("k"), F.lit("").alias("k2"), F.concat(F.lit('<node id="'), safe("id"), F.lit('">'), data(node_fields, "n"), F.lit("</node>")).alias("value"))
    # numbers by sorted ranges: the sizes of the ranges before, and the place within
    ranged = written(edges.repartitionByRange("source", "target", *edge_fields).sortWithinPartitions("source", "target", *edge_fields).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "graphml")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = ranged.join(F.broadcast(before), "range").withColumn("n", F.col("before") + F.col("at") - F.col("first") + 1)
    e = e.select(F.lit(2).alias("part"), "n", F.lit("").alias("k"), F.lit("").alias("k2"), F.concat(F.lit('<edge id="e'), F.col("n"), F.lit('" source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('">'), data(edge_fields, "e"), F.lit("</edge>")).alias("value"))
    last = spark.createDataFrame([(3, 0, "", "", "</graph></graphml>")], first.schema)
    first.unionByName(n).unionByName(e).unionByName(last).orderBy("part", "n", "k").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_review_sheet(df: DataFrame, path: str) -> None:
    """A sheet that begins with a byte order mark, as spreadsheets expect it; one row a sample, the header first."""
    names = df.columns
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = df.sparkSession.createDataFrame([(0, "\ufeff" + ",".join(f'"{n}"' for n in names))], "part int, value string")
    head.unionByName(df.select(F.lit(1).alias("part"), F.concat_ws(",", *[cell(c) for c in names]).alias("value"))).orderBy("part").select("value").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an image manifest: a JSON list, an object with items, or JSON lines; a line that can't be read is an error."""
    if not path.rstrip("/").endswith(".json"):
        return read_json_lines(spark, path, schema)
    raw = spark.read.text(path, wholetext=True)
    rows = T.ArrayType(schema)
    items = F.coalesce(F.from_json("value", rows), F.from_json(F.get_json_object("value", "$.items"), rows))
    listed = F.when(F.trim("value").startswith("{"), F.from_json(F.get_json_object("value", "$.items"), rows)).otherwise(items)
    return raw.select(F.explode(listed).alias("r")).select("r.*")


def backup(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Copies a file or folder beside itself under the stamp; its path, or None if there is nothing to copy."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.bak.{stamp}")
    fs = source.getFileSystem(conf)
    if not fs.exists(source):
        return None
    hadoop.FileUtil.copy(fs, source, fs, target, False, conf)
    return target.toString()


def knowledge_bases(listing: DataFrame, known: DataFrame) -> DataFrame:
    """known (kb_id, working_dir, created_at) with the folders of listing (working_dir, file_name, seen_at) that hold a graph or chunks and aren't known, newest first.

    A folder is known by its path; one that is listed twice is one.
    """
    valid = listing.filter(F.col("file_name").isin("graph_chunk_entity_relation.graphml", "kv_store_text_chunks.json")).groupBy(F.rtrim("working_dir", F.lit("/")).alias("working_dir")).agg(F.min("seen_at").alias("created_at"))
    have = known.select(F.rtrim("working_dir", F.lit("/")).alias("working_dir"))
    new = valid.join(have, "working_dir", "left_anti").withColumn("kb_id", F.concat(F.lit("kb_existing_"), file_name(F.col("working_dir")), F.lit("_"), F.substring(F.md5("working_dir"), 1, 8)))
    return known.select("kb_id", "working_dir", "created_at").unionByName(new.select("kb_id", "working_dir", "created_at")).orderBy(F.desc("created_at"), "kb_id")

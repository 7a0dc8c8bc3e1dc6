"""Sinks for graphs, layouts and sounds."""

from __future__ import annotations

import os
import uuid
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The head and foot of a GraphML file with node features and edge weights.
GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" ',
    '         xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" ',
    '         xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">',
    '  <key id="v_feat" for="node" attr.name="features" attr.type="string"/>',
    '  <key id="e_weight" for="edge" attr.name="weight" attr.type="double"/>',
    '  <graph id="G" edgedefault="directed">',
]
GRAPHML_FOOT = ["  </graph>", "</graphml>"]


def feature_string(features: Column) -> Column:
    return F.array_join(F.transform(features, lambda x: x.cast("string")), ",")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, a, b, line): the file's lines by element; part 0 head, 1 nodes, 2 edges, 3 foot. features and weight are
    optional columns. An element's own lines are joined by newlines, so one row is written as a whole."""
    spark = nodes.sparkSession
    fixed = lambda part, lines: spark.createDataFrame([(part, 0, i, x) for i, x in enumerate(lines)], "part int, a long, b long, line string")
    name = F.format_string('    <node id="n%d">', F.col("id").cast("long"))
    data = [F.concat(F.lit('      <data key="v_feat">'), feature_string(F.col("features")), F.lit("</data>"))] if "features" in nodes.columns else []
    node = nodes.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws("\n", name, *data, F.lit("    </node>")).alias("line"))
    ends = F.format_string('    <edge source="n%d" target="n%d"', F.col("source").cast("long"), F.col("target").cast("long"))
    if "weight" in edges.columns:
        body = F.concat_ws("\n", F.concat(ends, F.lit(">")), F.concat(F.lit('      <data key="e_weight">'), F.col("weight").cast("string"), F.lit("</data>")), F.lit("    </edge>"))
    else:
        body = F.concat(ends, F.lit("/>"))
    edge = edges.select(F.lit(2).alias("part"), F.col("source").cast("long").alias("a"), F.col("target").cast("long").alias("b"), body.alias("line"))
    return fixed(0, GRAPHML_HEAD).unionByName(node).unionByName(edge).unionByName(fixed(3, GRAPHML_FOOT))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Text files under path that make one GraphML document in the order of their names; ranges are sorted in parallel."""
    graphml_lines(nodes, edges).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b").select("line").write.mode("overwrite").text(path)


def write_graphml_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML document at path. Its parts are written in parallel, then put together in order by the file system: by
    reference where it can (HDFS), else as a stream of bytes that holds one buffer; the document takes its name as a whole."""
    spark = nodes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    where, top = lambda p: hadoop.fs.Path(p), f"{path}._parts-{uuid.uuid4().hex}"
    write_graphml(nodes, edges, top)
    files = where(path).getFileSystem(conf)
    parts = sorted((f.getPath() for f in files.listStatus(where(top)) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    whole = where(f"{top}/whole")
    out = files.create(whole)
    try:
        if files.getScheme() != "hdfs":
            for p in parts:
                source = files.open(p)
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
    finally:
        out.close()
    if files.getScheme() == "hdfs":
        array = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
        for i, p in enumerate(parts):
            array[i] = p
        files.concat(whole, array)
    files.delete(where(path), True)
    files.rename(whole, where(path))
    files.delete(where(top), True)


def layout_nodes(layout: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vertex, x, y, features as text), joined by id."""
    return layout.join(nodes.select(F.col("id").alias("vertex"), feature_string(F.col("features")).alias("features")), "vertex")


def layout_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "weight")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_wav(path: str, y: np.ndarray, rate: int = 22050) -> None:
    """16-bit mono sound of a signal within -1 and 1."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with wave.open(path, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(np.nan_to_num(y), -1, 1) * 32767).astype("<i2").tobytes())


def export_sounds(neighbours: dict[str, DataFrame], chain, axes, folder: str, limit: int = 10, rate: int = 22050) -> list[str]:
    """Wave files folder/method/rank.wav of the first limit + 1 neighbours of each method: a bounded few, on the driver."""
    out = []
    for method, df in neighbours.items():
        for r in df.where(F.col("rank") <= limit).select("rank", *axes).collect():
            out.append(f"{folder}/{method}/{r['rank']}.wav")
            write_wav(out[-1], chain.signal(np.array(list(r)[1:])), rate)
    return out


def frames(sounds: DataFrame, rate: int = 22050) -> DataFrame:
    """(row_id, frames, seconds, peak) of waveforms (row_id, y) as they would be written."""
    # rounding and clipping keep the order of sizes, so only the extremes go through them (NaN is the greatest, as for array_max)
    top = F.greatest(F.abs(F.array_max("y")), F.abs(F.array_min("y"))).cast("double")
    return sounds.select("row_id", F.size("y").alias("frames"), (F.size("y") / F.lit(float(rate))).alias("seconds"), F.round(F.when(top > 1, F.lit(1.0)).otherwise(top) * 32767).cast("int").alias("peak"))

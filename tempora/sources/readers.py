"""Readers and writers of transcript files, label files and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<word:string,punctuated_word:string,text:string,start:double,end:double,speaker:string>"
ASR = f"metadata struct<duration:double>, results struct<channels:array<struct<alternatives:array<struct<words:array<{WORD}>>>>>>"
ANY = f"words array<{WORD}>, segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>"


def _words(rows: DataFrame, listed: Column) -> DataFrame:
    """source_id, word_idx, text, start_ms, end_ms, speaker of documents; empty texts are dropped before words are numbered, each document's on its own in its row."""
    ms = lambda c: F.round(c * 1000).cast("long")
    named = lambda w: F.struct(F.trim(F.coalesce(w["punctuated_word"], w["word"], w["text"])).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["speaker"].alias("speaker"))
    out = rows.select("source_id", F.posexplode(F.filter(F.transform(listed, named), lambda w: w["text"] != "")).alias("word_idx", "w"))
    speaker = F.when(F.col("w.speaker").rlike("^[0-9]+$"), F.concat(F.lit("S"), (F.col("w.speaker").cast("int") + 1).cast("string"))).otherwise(F.col("w.speaker"))
    return out.select("source_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("w.text").alias("text"), ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"), speaker.alias("speaker"))


def read_documents(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """source_id, value: whole files by their names or, ``bundled``, the lines of files with many documents each: the source, a tab, the document in one line.

    A file a document costs its opening, so a large corpus is kept in bundles.
    """
    if not bundled:
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), "value")
    return spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("source_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))


def write_bundles(documents: DataFrame, path: str) -> None:
    """Documents (source_id, value of one line) as bundles for ``read_documents``: one file a task."""
    documents.select(F.concat_ws("\t", F.col("source_id").cast("string"), "value").alias("value")).write.text(path)


def read_transcripts(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Words of cloud speech-recognition JSON files, one document a file, or ``bundled`` (``read_documents``)."""
    if not bundled:
        rows = spark.read.schema(ASR).option("multiLine", True).json(path).select(F.input_file_name().alias("source_id"), "results")
    else:
        rows = read_documents(spark, path, True).select("source_id", F.from_json("value", ASR)["results"].alias("results"))
    return _words(rows, F.get(F.get(F.col("results.channels"), F.lit(0))["alternatives"], F.lit(0))["words"])


def read_words_json(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Words of documents of three shapes: a list, {words}, or {segments: [{words}]}; one a file, or ``bundled`` (``read_documents``).

    A document is parsed as a list only where the other shapes give no words, so most are parsed once.
    """
    parsed = read_documents(spark, path, bundled).withColumn("o", F.from_json("value", ANY))
    inner = F.flatten(F.transform("o.segments", lambda s: F.coalesce(s["words"], F.expr(f"cast(array() as array<{WORD}>)"))))
    return _words(parsed, F.coalesce(F.col("o.words"), inner, F.from_json("value", f"array<{WORD}>")))


def read_labels_jsonl(spark: SparkSession, path: str, classes: list[str], features: list[str]) -> DataFrame:
    """source_hash, gap_idx, label and features (NaN and missing: 0) of label lines; bad lines and unknown labels are skipped."""
    top = ", ".join(f"`{f}` double" for f in features)
    rows = spark.read.schema(f"sourceHash string, gapIdx int, label string, labelIndex int, features map<string,double>, {top}").option("mode", "DROPMALFORMED").json(path)
    named = F.coalesce("label", F.get(F.array(*(F.lit(c) for c in classes)), F.col("labelIndex")))
    value = lambda f: F.coalesce(F.nanvl(F.coalesce(F.element_at("features", f), F.col(f)), F.lit(0.0)), F.lit(0.0)).alias(f)
    return rows.select(F.col("sourceHash").alias("source_hash"), F.col("gapIdx").alias("gap_idx"), named.alias("label"), *(value(f) for f in features)).filter(F.col("label").isin(classes))


def _clock(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, ",", "."), ":")
    return (parts[0].cast("long") * 3_600_000 + parts[1].cast("long") * 60_000 + F.round(parts[2].cast("double") * 1000).cast("long")).cast("long")


def parse_srt(texts: DataFrame) -> DataFrame:
    """source_id, cue_idx, start_ms, end_ms, text of whole subtitle texts (source_id, value); blocks without a time line are skipped."""
    blocks = texts.select("source_id", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("cue_idx", "block"))
    time = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)[^\n]*\n?"
    found = blocks.filter(F.col("block").rlike(time))
    return found.select("source_id", "cue_idx", _clock(F.regexp_extract("block", time, 1)).alias("start_ms"), _clock(F.regexp_extract("block", time, 2)).alias("end_ms"), F.trim(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1)).alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), "value"))


def srt_texts(cues: DataFrame) -> DataFrame:
    """source_id, value: numbered cues ``HH:MM:SS,mmm --> HH:MM:SS,mmm`` of each source as one text."""
    clock = lambda c: F.format_string("%02d:%02d:%02d,%03d", (F.col(c) / 3_600_000).cast("int"), (F.col(c) / 60_000).cast("int") % 60, (F.col(c) / 1000).cast("int") % 60, (F.col(c) % 1000).cast("int"))
    numbered = cues.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "end_ms")))
    line = F.concat_ws("\n", F.col("n").cast("string"), F.concat(clock("start_ms"), F.lit(" --> "), clock("end_ms")), "text")
    return numbered.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("value"))


def write_srt(cues: DataFrame, path: str) -> None:
    srt_texts(cues).write.partitionBy("source_id").text(path)


def append_jsonl(df: DataFrame, path: str, day: str = "day") -> None:
    """Telemetry rows appended as JSON lines, a folder for each day."""
    df.write.mode("append").partitionBy(day).json(path)


def validate_schema(df: DataFrame, required: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """(the table with missing columns added as nulls of their type, the names that were missing)."""
    missing = [c for c in required if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(required[c]) for c in missing}), missing


def reconstruct_metadata(candidates: DataFrame, schema: str) -> DataFrame:
    """metadata (struct) parsed from metadata_json, with start_ms, end_ms and score from the core columns where it lacks them, as for null or blank JSON; corrupt flags bad JSON."""
    given = F.when(F.trim("metadata_json") != "", F.col("metadata_json"))
    parsed = candidates.withColumn("metadata", F.from_json(given, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    corrupt = F.coalesce(F.col("metadata._corrupt").isNotNull(), F.lit(False))
    fields = [x.split()[0] for x in schema.split(", ")]
    core = F.struct(*((F.coalesce(F.col(f"metadata.{f}"), F.col(f)) if f in candidates.columns else F.col(f"metadata.{f}")).alias(f) for f in fields))
    return parsed.withColumn("corrupt", corrupt).withColumn("metadata", core)


def pair_corpus(files: DataFrame, media: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """media file and the first existing transcript of its folder and stem, in the order of ``names``. files: path."""
    media, names = media or ["mp4", "mov", "mkv", "wav", "m4a", "mp3", "webm"], names or [".words.json", ".json", "_words.json", ".transcript.json"]
    parts = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    m = parts.filter(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(media)).select("dir", F.col("path").alias("media"), F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
    # a name may end in several of the suffixes, each with its own stem
    ranks = F.array(*(F.when(F.col("name").endswith(n), F.struct(F.lit(i).alias("rank"), F.expr(f"substring(name, 1, length(name) - {len(n)})").alias("stem"))) for i, n in enumerate(names)))
    t = parts.withColumn("r", F.explode(F.array_compact(ranks))).select("dir", F.col("r.stem").alias("stem"), F.col("r.rank").alias("rank"), F.col("path").alias("transcript"))
    best = m.join(t, ["dir", "stem"]).groupBy("media").agg(F.min(F.struct("rank", "transcript")).alias("b"))
    return best.select("media", F.col("b.transcript").alias("transcript"))


def canonical_source_url(url: Column) -> Column:
    """One id for the shapes of a video address (watch?v=, short host, shorts, live, embed); for others, host in lower case and path without query, fragment or end slash."""
    video = F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/shorts/([A-Za-z0-9_-]{11})", r"/live/([A-Za-z0-9_-]{11})", r"/embed/([A-Za-z0-9_-]{11})")))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.coalesce(F.concat(F.lit("video:"), video), F.concat(host, path))

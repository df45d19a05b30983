"""Scans and sinks of the record formats: delimited tables, sequence records, fixed-width atoms, hierarchy dumps, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, schema: str | None = None, most: int | None = None) -> DataFrame:
    """A table of text columns; the separator follows the suffix, else the first line. Compressed files are read as they are."""
    name = path.removesuffix(".gz")
    if name.endswith(".tsv"):
        sep = "\t"
    elif name.endswith(".csv"):
        sep = ","
    else:
        first = spark.read.text(path).limit(1).collect()
        line = first[0].value if first else ""
        sep = max("\t,;|", key=line.count)
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.limit(most) if most is not None else df


def sequence_records(spark: SparkSession, path: str) -> DataFrame:
    """``>id description [organism]`` records: (id, description, organism, length, sha256, sequence)."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "")
    rec = rec.select(F.regexp_extract(head, r"^(\S+)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), body.alias("sequence"))
    organism = F.nullif(F.regexp_extract("description", r"\[([^\[\]]*)\]\s*$", 1), F.lit(""))
    return rec.select("id", "description", organism.alias("organism"), F.length("sequence").alias("length"), F.sha2("sequence", 256).alias("sha256"), "sequence")


def flat_records(spark: SparkSession, path: str) -> DataFrame:
    """Annotated flat records that end in ``//``: (accession, locus, definition, organism, taxonomy, length, molecule, source,
    features array of (type, location, qualifiers)). Qualifiers are a map from name to the array of its values, in order; ``source``
    holds the first source feature's qualifiers taxon, host, segment, isolate, place and date."""
    rec = spark.read.option("lineSep", "\n//\n").text(path).where("value like '%LOCUS%'")
    field = lambda name: F.trim(F.regexp_extract("value", rf"(?m)^{name}\s+(.*)$", 1))
    block = F.substring_index(F.regexp_extract("value", r"(?s)FEATURES[^\n]*\n(.*)", 1), "\nORIGIN", 1)
    parts = F.filter(F.split(block, r"(?m)^ {5}(?=\S)"), lambda x: F.trim(x) != "")
    feature = F.transform(
        parts,
        lambda x: F.struct(
            F.regexp_extract(x, r"^(\S+)", 1).alias("type"),
            F.regexp_replace(F.regexp_extract(x, r"(?s)^\S+\s+(.*?)(?:\n\s+/|\z)", 1), r"\s+", "").alias("location"),
            _grouped(_qualifiers(x)).alias("qualifiers"),
        ),
    )
    locus = F.regexp_extract_all("value", F.lit(r"(?m)^LOCUS\s+(\S+)\s+(\d+)\s+bp\s+(\S+)"), F.lit(0))
    locus = F.coalesce(F.get(locus, 0), F.lit(""))
    lines = F.regexp_extract("value", r"(?s)\n  ORGANISM\s+([^\n]*(?:\n {12}[^\n]*)*)", 1)
    out = rec.select(
        field("ACCESSION").alias("accession"),
        F.regexp_extract(locus, r"^LOCUS\s+(\S+)", 1).alias("locus"),
        field("DEFINITION").alias("definition"),
        F.trim(F.substring_index(lines, "\n", 1)).alias("organism"),
        F.trim(F.regexp_replace(F.regexp_replace(lines, r"^[^\n]*", ""), r"\s+", " ")).alias("taxonomy"),
        F.regexp_extract(locus, r"(\d+)\s+bp", 1).try_cast("int").alias("length"),
        F.regexp_extract(locus, r"bp\s+(\S+)", 1).alias("molecule"),
        feature.alias("features"),
    )
    first = F.try_element_at(F.filter("features", lambda x: x["type"] == "source"), F.lit(1))["qualifiers"]
    one = lambda name: F.try_element_at(F.try_element_at(first, F.lit(name)), F.lit(1))
    taxon = F.regexp_extract(F.array_join(F.try_element_at(first, F.lit("db_xref")), " "), r"taxon:(\d+)", 1)
    source = F.struct(F.nullif(taxon, F.lit("")).alias("taxon"), *(one(n).alias(a) for n, a in (("host", "host"), ("segment", "segment"), ("isolate", "isolate"), ("geo_loc_name", "place"), ("collection_date", "date"))))
    return out.select("accession", "locus", "definition", "organism", "taxonomy", "length", "molecule", source.alias("source"), "features")


#: A qualifier at the start of a line: quoted (a doubled quote stands for one, lines may break), bare (goes on until the next slash), or
#: without a value. Matches follow each other, so a slash inside quotes starts nothing.
QUALIFIER = r'(?m)^[ \t]+/(\w+)(?:=("[^"]*+(?:""[^"]*+)*+"|[^"\n][^\n]*(?:\n[ \t]+(?![ \t/])[^\n]*)*))?'


def _qualifiers(feature: Column) -> Column:
    """The qualifiers of a feature in order, as structs (k, v); a qualifier without a value has the empty text."""

    def pair(halves: Column) -> Column:
        name, value = F.substring_index(halves[0], "/", -1), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        plain = F.when(F.startswith(value, F.lit('"')), F.replace(F.substr(value, F.lit(2), F.length(value) - 2), F.lit('""'), F.lit('"'))).otherwise(value)
        return F.struct(name.alias("k"), F.when(F.contains(value, F.lit("\n")), F.regexp_replace(plain, r"\s*\n\s*", " ")).otherwise(plain).alias("v"))

    found = F.regexp_extract_all(feature, F.lit(QUALIFIER), F.lit(0))
    return F.transform(F.transform(found, lambda q: F.split(F.rtrim(q), "=", 2)), pair)  # a name has no equals sign


def feature_rows(records: DataFrame, kind: str = "CDS") -> DataFrame:
    """One row for each feature of a kind in ``flat_records``: the record's accession, organism and source, names and product, the location as it
    stands and taken apart, the reading frame, the length of the translation and the names of the qualifiers without a value."""
    f = records.select("accession", "organism", F.col("source.taxon").alias("taxon"), F.col("source.segment").alias("segment"), "features")
    f = f.select("*", F.posexplode_outer("features").alias("place", "x")).drop("features").where(F.col("x.type") == kind)  # outer: else a filter on the size parses the text again
    one = lambda name: F.try_element_at(F.try_element_at(F.col("x.qualifiers"), F.lit(name)), F.lit(1))
    flags = F.filter(F.map_keys("x.qualifiers"), lambda k: F.array_max(F.try_element_at(F.col("x.qualifiers"), k)) == "")
    return f.select(
        "accession", "organism", "taxon", "segment", "place", F.col("x.type").alias("type"),
        *(one(n).alias(n) for n in ("protein_id", "gene", "locus_tag", "product", "note")),
        F.col("x.location").alias("location"), *(c.alias(n) for n, c in location(F.col("x.location")).items()),
        one("codon_start").try_cast("int").alias("codon_start"), F.length(F.regexp_replace(one("translation"), r"\s", "")).alias("translation_length"), F.array_sort(flags).alias("flags"),
    )


def _grouped(pairs: Column) -> Column:
    """A map from each name to the array of its values; names may repeat. The pairs are bound to a variable: each use of an expression in
    a lambda would parse the text again, once for each name."""

    def grouped(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda p: p["k"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(found, lambda p: p["k"] == n), lambda p: p["v"])))

    return F.get(F.transform(F.array(pairs), grouped), F.lit(0))


def location(c: Column | str) -> dict[str, Column]:
    """Columns of a location: kind, start, end, strand, parts, partial ends."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"[A-Za-z_][A-Za-z0-9_]*(?:\.[0-9]+)?:", "")  # accessions of remote parts
    n = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    parts = F.regexp_count(c, F.lit(r"\d+\.\."))
    kind = F.when(F.contains(c, F.lit("join")), "join").when(F.contains(c, F.lit("order")), "order").otherwise("simple")
    return {
        "kind": kind,
        "start": F.coalesce(F.array_min(n), F.lit(0)),
        "end": F.coalesce(F.array_max(n), F.lit(0)),
        "strand": F.when(F.contains(c, F.lit("complement")), -1).otherwise(1),
        "parts": F.greatest(parts, F.lit(1)),
        "partial_left": F.contains(c, F.lit("<")),
        "partial_right": F.contains(c, F.lit(">")),
    }


def atom_quality(spark: SparkSession, path: str, model: str = r"([^./]*)(?:\.[^/]*)?$") -> DataFrame:
    """Fixed-width atom lines, alpha carbons only: residues, mean and median confidence, shares of at least 70 and 90. A model's name
    is the first group of the pattern ``model`` in the file's path, by default the file name up to its first dot."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), model, 1).alias("model"))
    ca = lines.where("substring(value, 1, 4) = 'ATOM' and trim(substring(value, 13, 4)) = 'CA'").select("model", F.substring("value", 22, 5).alias("residue"), F.trim(F.substring("value", 61, 6)).try_cast("double").alias("b"))
    return ca.groupBy("model").agg(F.count_distinct("residue").alias("residues"), F.avg("b").alias("mean"), F.percentile("b", F.lit(0.5)).alias("median"), F.avg((F.col("b") >= 70).cast("int")).alias("high"), F.avg((F.col("b") >= 90).cast("int")).alias("very_high"))


def dump(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of fields between tab-bar-tab."""
    f = F.split(F.regexp_replace("value", r"\t\|\s*$", ""), r"\t\|\t")
    return spark.read.text(path).select(*(F.try_element_at(f, F.lit(k + 1)).alias(n) for k, n in enumerate(names)))


HIT_COLUMNS = ["query", "target", "pident", "evalue", "bits", "qcov", "tcov"]


def hit_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated hits with or without a header; short rows are padded with null."""
    text = spark.read.text(path)
    first = text.limit(1).collect()
    head = first[0].value.split("\t") if first else []
    names = head if head[:2] == ["query", "target"] else HIT_COLUMNS
    f = F.split("value", "\t")
    rows = text.where(F.col("value") != "\t".join(head)) if names is head else text
    return rows.select(*(F.nullif(F.try_element_at(f, F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate(names)))


#: Fields of a run's two files; a field that a file lacks is null, further ones are left out.
MANIFEST = "task_mode string, split_strategy struct<scheme: string>, sequence_backbone string, biophysics_fields array<string>, selected_context_blocks array<string>, context_control string, host_corruption_fraction double, host_corrupted_count long"
_PART = "struct<macro_average_precision: double, micro_average_precision: double, macro_f1: double, micro_f1: double>"
METRICS = f"best_epoch long, validation {_PART}, test {_PART}"


def run_registry(spark: SparkSession, root: str) -> DataFrame:
    """One row for each folder at any depth that has a run_manifest.json and a metrics_summary.json: the run's name (its folder's), what it
    was made of, and its metrics."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")

    def read(name: str, schema: str) -> DataFrame:
        files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.json").json(root)
        return files.select(folder.alias("run_dir"), "*")

    runs = read("run_manifest", MANIFEST).join(read("metrics_summary", METRICS), "run_dir")
    return runs.select(
        F.substring_index("run_dir", "/", -1).alias("run_name"),
        F.coalesce("task_mode", F.lit("")).alias("task_mode"),
        F.coalesce("split_strategy.scheme", F.lit("")).alias("split_scheme"),
        F.coalesce("sequence_backbone", F.lit("")).alias("sequence_backbone"),
        (F.coalesce(F.size("biophysics_fields"), F.lit(0)) > 0).alias("with_biophysics"),
        F.concat_ws(",", F.coalesce("selected_context_blocks", F.array().cast("array<string>"))).alias("selected_context_blocks"),
        F.coalesce("context_control", F.lit("none")).alias("context_control"),
        "host_corruption_fraction",
        F.coalesce("host_corrupted_count", F.lit(0)).alias("host_corrupted_count"),
        "best_epoch",
        *(F.col(f"{p}.{m}").alias(f"{p}_{m}") for p in ("validation", "test") for m in ("macro_average_precision", "micro_average_precision", "macro_f1", "micro_f1")),
        "run_dir",
    )


def write_runs(runs: DataFrame, root: str, folders: list[str], manifest: list[str], metrics: list[str]) -> None:
    """The files of ``run_registry`` in nested folders named by the columns ``folders``, one folder for each row; a row without any metric gets
    a manifest only. One file a run: it is for tables of runs, whose folders the driver lists."""
    spark = runs.sparkSession
    for name, columns in (("run_manifest", manifest), ("metrics_summary", metrics)):
        own = runs if name == "run_manifest" else runs.where(" or ".join(f"`{c}` is not null" for c in columns))
        part = f"{root}/.{name}"
        own.select(*folders, *columns).repartition(*folders).write.mode("overwrite").partitionBy(*folders).json(part)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listFiles(path(part), True)
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().startswith("part-"):
                inside = at.getParent().toString().split(f"/.{name}/", 1)[1]
                files.mkdirs(path(f"{root}/{inside}"))
                files.rename(at, path(f"{root}/{inside}/{name}.json"))
        files.delete(path(part), True)


def write_delimited(df: DataFrame, path: str, columns: list[str], gz: bool = False) -> None:
    """Tab-separated with a fixed column order; other columns are left out."""
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip" if gz else "none")


def write_flat(texts: DataFrame, path: str, most: int = 50_000) -> None:
    """Flat records, each a text that ends in ``//``, as compressed files of ``most`` records at most: a compressed file is read in one piece."""
    texts.write.mode("overwrite").option("maxRecordsPerFile", most).text(path, compression="gzip")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_sequences(df: DataFrame, path: str, identity: str = "id", sequence: str = "sequence", alphabet: str = "A-Z") -> None:
    """Sequence records in lines of 80, cleaned to the alphabet."""
    clean = F.regexp_replace(F.upper(sequence), f"[^{alphabet}]", "")
    df.select(F.concat(F.lit(">"), F.col(identity).cast("string"), F.lit("\n"), F.regexp_replace(clean, "(.{80})(?=.)", "$1\n"))).write.mode("overwrite").text(path)

"""Members of packages and trees: categories, totals, order-free hashes, bases of bundles, imports, tool diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Suffixes of signature files, names of code files, and patterns of a decompiler's messages.
SIGNATURE_SUFFIXES = [".MF", ".SF", ".RSA", ".DSA", ".EC"]
DEX_NAME = r"^classes(?:[2-9]|[1-9][0-9]+)?\.dex$"
WARNING, ERROR = r"(?i)\bwarn(?:ing)?\b", r"(?i)\b(?:error|fatal)\b"
ERROR_COUNT = r"(?i)finished\s+with\s+errors\s*,?\s*count\s*:\s*(\d+)"
# Names (lower case, underscores) of metadata fields that name a base, refer to a file, or give a role or an id.
BASE_KEYS = ["base_apk", "baseapk", "base_file", "basefile"]
FILE_KEYS = ["file", "filename", "path", "apk", "apk_file"]
FLAG_KEYS = ["is_base", "isbase"]
ROLE_KEYS = ["id", "split", "split_id", "type", "role"]
ID_KEYS = ["id", "split", "split_id"]
BASE_ROLES = ["base", "master"]


def member_category(name: Column) -> Column:
    """asset, resource, native, nonstandard-lib, dex, or null for what an inventory leaves out."""
    parts = F.split(name, "/")
    return (
        F.when(F.startswith(name, F.lit("assets/")), "asset")
        .when(F.startswith(name, F.lit("res/")) | (name == "resources.arsc"), "resource")
        .when(
            F.startswith(name, F.lit("lib/")),
            F.when((F.size(parts) == 3) & F.endswith(name, F.lit(".so")), "native").otherwise("nonstandard-lib"),
        )
        .when(name.rlike(DEX_NAME), "dex")
    )


def legacy_signature(name: Column) -> Column:
    upper = F.upper(name)
    ends = F.lit(False)
    for s in SIGNATURE_SUFFIXES:
        ends = ends | F.endswith(upper, F.lit(s))
    return F.startswith(upper, F.lit("META-INF/")) & ends


def categorised(members: DataFrame) -> DataFrame:
    """members (package, name, size, sha256) once for each inventory that they belong to: adds category. A signature file has
    its own, also beside another; names outside all inventories go."""
    own = members.withColumn("category", member_category(F.col("name"))).where("category is not null")
    legacy = members.where(legacy_signature(F.col("name"))).withColumn("category", F.lit("signature"))
    return own.unionByName(legacy)


def category_totals(members: DataFrame, order: str = "size") -> DataFrame:
    """(package, category, entries, bytes) of each inventory, and as category `all` of the distinct names of all of them. Of entries
    with a package and name in common, `all` takes the size of the first by the column `order` that has one (then the least size)."""
    listed = categorised(members).where("category <> 'nonstandard-lib'")
    each = listed.groupBy("package", "category").agg(
        F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes")
    )
    first = F.min(F.when(F.col("size").isNotNull(), F.struct(F.col(order).alias("order"), "size")))
    union = listed.groupBy("package", "name").agg(first["size"].alias("size")).groupBy("package").agg(
        F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes")
    )
    return each.unionByName(union.withColumn("category", F.lit("all")))


def tree_hash(files: DataFrame, key: str) -> DataFrame:
    """files (key, name, size, sha256): (key, files, bytes, sha256): one hash over names, sizes and digests in the order of names,
    each name and size behind its length in 8 bytes. An entry takes about 100 bytes of the key's row: key by a package or a tree."""
    entry = F.concat(
        F.lpad(F.hex(F.octet_length("name")), 16, "0"),
        F.hex(F.encode("name", "UTF-8")),
        F.lpad(F.hex("size"), 16, "0"),
        F.upper("sha256"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.encode("name", "UTF-8").alias("n"), entry.alias("e"))))
    whole = F.unhex(F.array_join(F.transform(ordered, lambda x: x.e), ""))
    return files.groupBy(key).agg(
        F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.sha2(whole, 256).alias("sha256")
    )


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names: what a decompiled tree depends on."""
    return F.sha2(
        F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256
    )


def cache_state(markers: DataFrame, trees: DataFrame, key: str) -> DataFrame:
    """markers (key, files, bytes, sha256) of what a run left, trees the same of what is there: (key, state).

    valid, changed (another hash, count or size), lost (a marker without a tree) or unmarked.
    """
    there = trees.select(key, F.struct("files", "bytes", "sha256").alias("_now"))
    both = markers.select(key, F.struct("files", "bytes", "sha256").alias("_then")).join(there, key, "full")
    state = F.when(F.col("_now").isNull(), "lost").when(F.col("_then").isNull(), "unmarked").when(
        F.col("_now") == F.col("_then"), "valid"
    ).otherwise("changed")
    return both.select(key, state.alias("state"))


def diagnostics(output: DataFrame, key: str, exit_code: str | None = None) -> DataFrame:
    """output (key, n, line; exit_code): (key, kind, nth, line): each warning and error once, in the order in which they came.

    A run that failed without an error line gets one: its exit code and its last line that is not blank.
    """
    lines = output.withColumn("line", F.trim("line")).where("line <> ''")
    kinds = F.array_compact(
        F.array(F.when(F.col("line").rlike(WARNING), "warning"), F.when(F.col("line").rlike(ERROR), "error"))
    )
    first = lines.select(
        key, "n", "line", F.explode(kinds).alias("kind")
    ).groupBy(key, "kind", "line").agg(F.min("n").alias("n"))
    if exit_code:
        failed = output.where(F.col(exit_code) != 0).groupBy(key).agg(
            F.max(exit_code).alias("_code"), F.max("n").alias("n")
        )
        last = lines.groupBy(key).agg(F.max_by("line", "n").alias("_last"))
        silent = failed.join(
            first.where("kind = 'error'").select(key).distinct(), key, "left_anti"
        ).join(last, key, "left")
        text = F.concat(
            F.lit("exit code "),
            F.col("_code").cast("string"),
            F.coalesce(F.concat(F.lit(": "), F.left("_last", F.lit(2000))), F.lit("")),
        )
        first = first.unionByName(silent.select(key, F.lit("error").alias("kind"), text.alias("line"), "n"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy("n", "line"))
    return first.select(key, "kind", nth.cast("long").alias("nth"), "line")


def reported_errors(found: DataFrame, key: str) -> DataFrame:
    """(key, errors): the largest count that a diagnostic reports."""
    count = F.regexp_extract("line", ERROR_COUNT, 1).try_cast("long")
    return found.groupBy(key).agg(F.max(count).alias("errors")).where("errors is not null")


def evidence_count(packages: DataFrame) -> DataFrame:
    """packages with arrays assets, resources, native, dex, legacy, unsupported and schemes (signers: certificates, signatures):
    adds evidence, the number of all that is listed, schemes and signers included."""
    flat = sum(
        (F.coalesce(F.size(c), F.lit(0)) for c in ("assets", "resources", "native", "dex", "legacy", "unsupported")),
        F.lit(0),
    )
    signer = lambda a, s: a + 1 + F.size(s.certificates) + F.size(s.signatures)
    nested = F.aggregate("schemes", F.lit(0), lambda a, s: a + 1 + F.aggregate(s.signers, F.lit(0), signer))
    return packages.withColumn("evidence", (flat + F.coalesce(nested, F.lit(0))).cast("long"))


def base_packages(packages: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """packages (bundle, name, has_dex), named (bundle, name: what metadata calls the base): (bundle, base, problem).

    The first rule that finds any decides: metadata, a file called base.apk (case does not count), the only one, the only one
    with code. Several by metadata or by name are a problem, and so is a bundle in which no rule finds one.
    """
    rows = packages.select("bundle", "name", "has_dex")
    if named is None:
        rows = rows.withColumn("told", F.lit(False))
    else:
        rows = rows.join(
            named.select("bundle", "name", F.lit(True).alias("told")).distinct(), ["bundle", "name"], "left"
        ).withColumn("told", F.coalesce("told", F.lit(False)))
    called = F.lower(F.substring_index("name", "/", -1)) == "base.apk"
    rules = {"told": F.col("told"), "called": called, "coded": F.col("has_dex")}
    g = rows.groupBy("bundle").agg(
        F.count("*").alias("n"), F.max("name").alias("any"), *[F.count_if(p).alias(f"n_{k}") for k, p in rules.items()], *[
            F.max(F.when(p, F.col("name"))).alias(k) for k, p in rules.items()
        ]
    )
    one = lambda k: F.col(f"n_{k}") == 1
    problem = F.when(F.col("n_told") > 1, "several-by-metadata").when(
        (F.col("n_told") == 0) & (F.col("n_called") > 1), "several-by-name"
    )
    base = F.when(
        problem.isNotNull(), F.lit(None)
    ).when(one("told"), F.col("told")).when(one("called"), F.col("called")).when(F.col("n") == 1, F.col("any")).when(one("coded"), F.col("coded"))
    return g.select(
        "bundle", base.alias("base"), F.coalesce(problem, F.when(base.isNull(), "no-base")).alias("problem")
    )


def resolve(references: DataFrame, members: DataFrame) -> DataFrame:
    """references (bundle, reference) beside members (bundle, name): adds name and problem: the member of that name, else the only one with
    that file name; `missing` or `ambiguous` otherwise."""
    tidy = F.regexp_replace(F.replace(F.col("reference"), F.lit("\\"), F.lit("/")), r"^\./", "")
    asked = references.select("*", tidy.alias("_exact"), F.substring_index(tidy, "/", -1).alias("_file"))
    exact = members.select("bundle", F.col("name").alias("_exact"), F.col("name").alias("_whole")).distinct()
    files = members.select(
        "bundle", F.substring_index("name", "/", -1).alias("_file"), "name"
    ).distinct().groupBy("bundle", "_file").agg(F.count("*").alias("_n"), F.max("name").alias("_only"))
    met = asked.join(exact, ["bundle", "_exact"], "left").join(files, ["bundle", "_file"], "left")
    name = F.coalesce("_whole", F.when(F.col("_n") == 1, F.col("_only")))
    problem = F.when(name.isNull(), F.when(F.col("_n").isNull(), "missing").otherwise("ambiguous"))
    return met.select(*references.columns, name.alias("name"), problem.alias("problem"))


def metadata_records(documents: DataFrame, depth: int = 8) -> DataFrame:
    """documents (bundle, json): (bundle, record map<string,string>) of every object within, `depth` levels deep at most.

    Names are lower-cased with underscores for hyphens; of equal ones the last counts; a value is its JSON text, quotes included.
    """
    level = documents.select("bundle", F.try_parse_json("json").alias("v")).where("v is not null")
    found = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        objects = level.where(F.startswith(kind, F.lit("OBJECT"))).select("bundle", F.to_json("v").alias("j"))
        records = objects.select("bundle", F.from_json("j", "map<string,variant>").alias("m"))
        tidy = F.transform(
            F.map_entries("m"),
            lambda e: F.struct(F.replace(F.lower(e.key), F.lit("-"), F.lit("_")).alias("key"), e.value.alias("value")),
        )
        some = records.select("bundle", tidy.alias("fields"))
        found = some if found is None else found.unionByName(some)
        inner = records.select("bundle", F.explode(F.map_values("m")).alias("v"))
        items = level.where(F.startswith(kind, F.lit("ARRAY"))).select(
            "bundle", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")
        )
        nested = F.schema_of_variant("v")
        level = inner.unionByName(items).where(
            F.startswith(nested, F.lit("OBJECT")) | F.startswith(nested, F.lit("ARRAY"))
        )
    return found


def _first_text(keys: list[str], good=lambda v: F.lit(True)) -> Column:
    """The first text among the record's fields so named for which `good` holds."""
    text = lambda e: F.when(F.schema_of_variant(e.value) == "STRING", F.try_variant_get(e.value, "$", "string"))
    fit = F.filter("fields", lambda e: e.key.isin(keys) & text(e).isNotNull() & good(text(e)))
    return F.get(F.transform(fit, text), F.lit(0))


def metadata_roles(documents: DataFrame, depth: int = 8) -> DataFrame:
    """documents (bundle, json): (bundle, reference, is_base, split_id) of what metadata says about package files, at any depth."""
    records = metadata_records(documents, depth)
    reference = _first_text(FILE_KEYS, lambda v: F.endswith(F.lower(v), F.lit(".apk")))
    flagged = F.exists("fields", lambda e: e.key.isin(FLAG_KEYS) & (F.try_variant_get(e.value, "$", "boolean") == True))  # noqa: E712
    role = _first_text(ROLE_KEYS, lambda v: F.lower(v).isin(BASE_ROLES))
    split = _first_text(ID_KEYS, lambda v: ~F.lower(v).isin(BASE_ROLES))
    told = records.select(
        "bundle",
        reference.alias("reference"),
        (F.coalesce(flagged, F.lit(False)) | role.isNotNull()).alias("is_base"),
        split.alias("split_id"),
    ).where("reference is not null")
    direct = records.select(
        "bundle",
        _first_text(BASE_KEYS).alias("reference"),
        F.lit(True).alias("is_base"),
        F.lit(None).cast("string").alias("split_id"),
    ).where("reference is not null")
    return told.unionByName(direct)


def split_id(name: Column) -> Column:
    """Of a split's file name: without folders, suffix and the prefix `split_`."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", ""), "^split_", "")


def stored_path(project: Column, sha256: Column) -> Column:
    """Where a blob of this content lies below the store."""
    return F.concat(project, F.lit("/"), F.left(sha256, F.lit(2)), F.lit("/"), sha256, F.lit("/blob"))


def import_blobs(files: DataFrame, store: DataFrame) -> DataFrame:
    """files (project_id, name, size, sha256) beside what is stored (project_id, sha256, size): (project_id, sha256, size, name,
    stored_path, state): new, known, or damaged where the stored size differs. Files of one content are one blob, by the least name."""
    one = files.groupBy("project_id", "sha256").agg(F.min("name").alias("name"), F.max("size").alias("size"))
    held = store.select("project_id", "sha256", F.col("size").alias("_size")).dropDuplicates(["project_id", "sha256"])
    met = one.join(held, ["project_id", "sha256"], "left")
    state = F.when(F.col("_size").isNull(), "new").when(F.col("_size") == F.col("size"), "known").otherwise("damaged")
    return met.select(
        "project_id",
        "sha256",
        "size",
        "name",
        stored_path(F.col("project_id"), F.col("sha256")).alias("stored_path"),
        state.alias("state"),
    )


def import_bundle(inspected: DataFrame, stored: DataFrame) -> DataFrame:
    """inspected (bundle, name, size, sha256) beside the members as they were stored: adds state: imported, missing, or changed where
    size or digest are others than at the inspection."""
    now = stored.select("bundle", "name", F.struct("size", "sha256").alias("_now"))
    met = inspected.join(now, ["bundle", "name"], "left")
    state = F.when(F.col("_now").isNull(), "missing").when(
        F.col("_now") == F.struct("size", "sha256"), "imported"
    ).otherwise("changed")
    return met.select(*inspected.columns, state.alias("state"))

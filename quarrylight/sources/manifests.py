"""Manifest XML as rows of elements, and what Spark makes of these: components, permissions, filters, flags, warnings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylight.operators.manifest import dangerous, tri_state
from quarrylight.session import for_workers

MOST_BYTES = 10 << 20
ELEMENT = "file string, number int, tag string, locator string, parent string, attributes map<string,string>, problem string"
# The attributes' namespace, and which elements are components.
SPACE = "{http://schemas.android.com/apk/res/android}"
KINDS = ("activity", "activity-alias", "service", "receiver", "provider")
# What a warning says behind the place that it is about, and of its value.
NOT_LITERAL = "{} is not a literal boolean; its effective value remains indeterminate without Android resource resolution."
TREATED = "treated conservatively as true in the boolean summary."
TARGET_SDK = "value is not a numeric API level; exported defaults that depend on target SDK remain indeterminate."
LEAST_SDK = "value is not a numeric API level and targetSdkVersion is absent; exported defaults that depend on target SDK remain indeterminate."
NO_APPLICATION = "manifest has no application element"
#: Booleans of the application, and of a component.
APPLICATION_FLAGS, COMPONENT_FLAGS = ("enabled", "debuggable", "allowBackup", "usesCleartextTraffic"), ("exported", "enabled")


def refused(raw: bytes) -> str | None:
    """Why a manifest is not read."""
    if len(raw) > MOST_BYTES:
        return "too-large"
    if not raw.lstrip().startswith((b"<", b"\xef\xbb\xbf")):
        return "binary-xml"
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", raw, re.I):
        return "document-type"
    return None


def walk(raw: bytes) -> Iterator[tuple]:
    """(number, tag, locator, parent, attributes, problem) of each element in document order. A locator counts an element among those of
    its tag below one parent, but for the root and the application. Attributes without value are left out, and so are namespaces."""
    if wrong := refused(raw):
        yield None, None, None, None, None, wrong
        return
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        yield None, None, None, None, None, "malformed"
        return
    if root.tag.rsplit("}", 1)[-1] != "manifest" or not root.get("package", "").strip():
        yield None, None, None, None, None, "no-manifest"
        return
    stack, number = [(root, "/manifest", "")], 0
    while stack:
        e, locator, parent = stack.pop()
        found = {k.rsplit("}", 1)[-1]: v.strip() for k, v in e.attrib.items() if v.strip()}
        yield number, e.tag.rsplit("}", 1)[-1], locator, parent, list(found.items()), None
        number += 1
        seen: Counter = Counter()
        below = []
        for child in e:
            tag = child.tag.rsplit("}", 1)[-1]
            seen[tag] += 1
            one = locator == "/manifest" and tag == "application" and seen[tag] == 1
            below.append((child, f"{locator}/{tag}" if one else f"{locator}/{tag}[{seen[tag]}]", locator))
        stack += reversed(below)


def elements(files: DataFrame) -> DataFrame:
    """A row of ELEMENT for each element of each manifest (file, content: binary or text); one with a problem for a file that is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        kinds = (text, pa.int32(), text, text, text, pa.map_(text, text), text)
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, *e) for e in walk(raw or b"")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["file", "number", "tag", "locator", "parent", "attributes", "problem"],
                )

    for_workers(files.sparkSession)
    return files.select(F.col("file").cast("string"), F.col("content").cast("binary")).mapInArrow(run, ELEMENT)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """elements of the files below path. A file over the limit is not read, but told."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= MOST_BYTES).select(F.col("path").alias("file"), "content")
    large = files.where(F.col("length") > MOST_BYTES).select("path")
    none = [F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in ELEMENT.split(", ")[1:-1]]
    return elements(small).unionByName(large.select(F.col("path").alias("file"), *none, F.lit("too-large").alias("problem")))


def _is(name: str) -> Column:
    return F.col("attributes")[name]


def _qualified(name: Column, package: Column) -> Column:
    return F.when(F.startswith(name, F.lit(".")), F.concat(package, name)).when(
        ~F.contains(name, F.lit(".")), F.concat(package, F.lit("."), name)
    ).otherwise(name)


def heads(rows: DataFrame) -> DataFrame:
    """A row for each manifest: package, versions, SDKs, the application's flags and permission.

    debuggable: false where it is not said, true where what is said is no literal boolean; the others are null then.
    """
    root, app, sdk = F.col("locator") == "/manifest", F.col("locator") == "/manifest/application", F.col("locator") == "/manifest/uses-sdk[1]"
    of = lambda where, name: F.max(F.when(where, _is(name)))
    grouped = rows.where("problem is null").groupBy("file").agg(
        of(root, "package").alias("package"),
        of(root, "versionName").alias("version_name"),
        of(root, "versionCode").alias("version_code"),
        of(sdk, "minSdkVersion").alias("min_sdk"),
        of(sdk, "targetSdkVersion").alias("target_sdk"),
        F.bool_or(app).alias("has_application"),
        *[of(app, n).alias(f"_{n}") for n in APPLICATION_FLAGS],
        of(app, "permission").alias("application_permission"),
    )
    said = lambda n: tri_state(F.col(f"_{n}"))
    return grouped.withColumns(
        {
            "debuggable": F.when(F.col("_debuggable").isNull(), False).otherwise(F.coalesce(said("debuggable"), F.lit(True))),
            "allow_backup": said("allowBackup"),
            "uses_cleartext_traffic": said("usesCleartextTraffic"),
            "application_enabled": F.when(F.col("_enabled").isNull(), True).otherwise(said("enabled")),
        }
    ).drop(*[f"_{n}" for n in APPLICATION_FLAGS])


def components(rows: DataFrame) -> DataFrame:
    """A row for each component, with what its manifest's head says of it; and one for each file with a problem."""
    parts = rows.where((F.col("parent") == "/manifest/application") & F.col("tag").isin(*KINDS))
    with_filter = rows.where("tag = 'intent-filter'").select("file", F.col("parent").alias("locator")).distinct().withColumn("has_filter", F.lit(True))
    named = F.coalesce(_is("name"), F.lit("<unnamed>"))
    own = F.when(_is("enabled").isNull(), True).otherwise(tri_state(_is("enabled")))
    met = parts.join(with_filter, ["file", "locator"], "left").join(heads(rows), "file")
    both = F.when((own == F.lit(False)) | ~F.coalesce("application_enabled", F.lit(True)), False).when(own & F.col("application_enabled"), True)
    out = met.select(
        "file",
        "package",
        F.col("tag").alias("kind"),
        _qualified(named, F.col("package")).alias("name"),
        _is("exported").alias("exported_attribute"),
        both.alias("enabled"),
        F.coalesce("has_filter", F.lit(False)).alias("has_filter"),
        _is("permission").alias("permission"),
        _is("readPermission").alias("read_permission"),
        _is("writePermission").alias("write_permission"),
        _is("authorities").alias("authorities"),
        "application_permission",
        "target_sdk",
        "min_sdk",
        "locator",
        F.lit(None).cast("string").alias("problem"),
    )
    return out.unionByName(rows.where("problem is not null").select("file", "problem"), allowMissingColumns=True)


def permissions(rows: DataFrame) -> DataFrame:
    """(file, name, dangerous, max_sdk, locator) of each permission that a manifest asks for; max_sdk: null where it is no number."""
    asked = rows.where((F.col("parent") == "/manifest") & F.col("tag").isin("uses-permission", "uses-permission-sdk-23"))
    name = F.coalesce(_is("name"), F.lit("<unnamed>"))
    return asked.select(
        "file", name.alias("name"), dangerous(name).alias("dangerous"), _is("maxSdkVersion").try_cast("int").alias("max_sdk"), "locator"
    )


def features(rows: DataFrame) -> DataFrame:
    """(file, feature), each once."""
    return rows.where("parent = '/manifest' AND tag = 'uses-feature'").select("file", _is("name").alias("feature")).where("feature is not null").distinct()


def filters(rows: DataFrame) -> DataFrame:
    """(file, component, locator, actions, categories, data) of each intent filter of a component; data: the attributes of its data
    elements, in their order, each sorted by name."""
    own = rows.where((F.col("tag") == "intent-filter") & F.regexp_like("parent", F.lit("^/manifest/application/[^/]+$"))).select(
        "file", F.col("parent").alias("component"), "locator"
    )
    inside = rows.where(F.col("tag").isin("action", "category", "data")).select("file", F.col("parent").alias("locator"), "tag", "number", "attributes")
    names = lambda tag: F.array_sort(F.collect_list(F.when(F.col("tag") == tag, _is("name"))))
    data = F.when(F.col("tag") == "data", F.struct("number", F.array_sort(F.map_entries("attributes")).alias("pairs")))
    met = own.join(inside, ["file", "locator"], "left")
    return met.groupBy("file", "component", "locator").agg(
        names("action").alias("actions"),
        names("category").alias("categories"),
        F.transform(F.array_sort(F.collect_list(data)), lambda d: F.map_from_entries(d.pairs)).alias("data"),
    )


def warnings(rows: DataFrame) -> DataFrame:
    """(file, locator, warning): flags that are no literal booleans, SDKs that are no numbers, and manifests without an application.
    What the export rules warn of is manifest.export_warnings'."""
    app = F.col("locator") == "/manifest/application"
    part = (F.col("parent") == "/manifest/application") & F.col("tag").isin(*KINDS)
    flag = lambda n: F.when(_is(n).isNotNull() & tri_state(_is(n)).isNull(), F.struct(F.lit(n).alias("n"), _is(n).alias("v")))
    told = F.when(app, F.array_compact(F.array(*[flag(n) for n in APPLICATION_FLAGS]))).when(
        part, F.array_compact(F.array(*[flag(n) for n in COMPONENT_FLAGS]))
    )
    place = F.concat("locator", F.lit("/@android:"), F.col("f.n"))
    quoted = F.concat(F.lit("value '"), F.col("f.v"), F.lit("'" + NOT_LITERAL.removeprefix("{}")))
    wrong = rows.select("file", "locator", F.explode(told).alias("f"))
    flags = wrong.select("file", place.alias("locator"), quoted.alias("warning"))
    more = wrong.where(F.col("f.n") == "debuggable").select("file", place.alias("locator"), F.lit(TREATED).alias("warning"))
    sdk = rows.where("locator = '/manifest/uses-sdk[1]'")
    bad = lambda n: _is(n).isNotNull() & (F.coalesce(_is(n).try_cast("int"), F.lit(0)) < 1)
    target = sdk.where(bad("targetSdkVersion")).select("file", F.concat("locator", F.lit("/@android:targetSdkVersion")).alias("locator"), F.lit(TARGET_SDK).alias("warning"))
    least = sdk.where(_is("targetSdkVersion").isNull() & bad("minSdkVersion")).select(
        "file", F.concat("locator", F.lit("/@android:minSdkVersion")).alias("locator"), F.lit(LEAST_SDK).alias("warning")
    )
    without = heads(rows).where("NOT has_application").select("file", F.lit("/manifest").alias("locator"), F.lit(NO_APPLICATION).alias("warning"))
    return flags.unionByName(more).unionByName(target).unionByName(least).unionByName(without)


def read(spark: SparkSession, path: str) -> DataFrame:
    """components of every manifest below path. Document types and binary XML are refused."""
    return components(read_elements(spark, path))

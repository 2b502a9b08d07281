"""Chunks of Java, Kotlin and Smali sources, and components of manifests."""

import time

from pyspark.sql import functions as F

from quarrylight.operators import declarations, manifest
from quarrylight.sources import manifests

JAVA = """package a;
class Outer {
  // void no() {
  Outer() {
    String s = "}";
  }
  @Override
  public List<String> run(int x) throws E {
    if (x > 0) { return new Foo() { }; }
  }
  static class Inner {
    int size() { return 1; }
  }
}
"""
KOTLIN = """class K(val a: Int) {
  init {
    a()
  }
  fun `long name`(x: Int): Int {
    return x
  }
  fun short() = 1
}
object O {
}
"""
SMALI = """.class public La/b/C;
.method public run(I)V
    .locals 1
    const v0, 1
    return-void
.end method
# note
.method static x()I
    return v0
.end method
.method open()V
"""


def test_java():
    got = declarations.constructs(JAVA, kotlin=False)
    assert got == [
        ("type", "Outer", 2, 14),
        ("method", "Outer.Outer", 4, 6),
        ("method", "Outer.run", 7, 10),
        ("type", "Outer.Inner", 11, 13),
        ("method", "Outer.Inner.size", 12, 12)
    ]


def test_kotlin():
    got = declarations.constructs(KOTLIN, kotlin=True)
    assert got == [
        ("type", "K", 1, 9),
        ("method", "K.init", 2, 4),
        ("method", "K.long name", 5, 7),
        ("method", "K.short", 8, 8),
        ("type", "O", 10, 11)
    ]


def found(text, kotlin):
    return [(k, s, a, b) for k, s, a, b in declarations.constructs(text, kotlin)]


def test_java_heads():
    """Annotations belong to methods, not to types; heads over several lines; what is no method; arguments that nest."""
    text = """@Entity
public
  final class A<T extends B> {
    @Deprecated
    @Named("a(b)") // note
    public static <T> a.b.List<T> [ ]
      make(@X(1) int a,
           int b) throws java.io.IOException,
      Other {
    }
    Map<String, List<T>> nested(int x) {
    }
    A(int x)
    {
        if (x) {
        }
        else if (x) {
        }
        for (int i = 0; i < 1; i++) {
        }
        synchronized (this) {
        }
        new Thread(this) {
            public void run() {
            }
        };
        call(x, new Runnable() {
            void go() {}
        });
    }
    B(int y) {
    }
    abstract int none(int x);
    int x() { return 1; }  int hidden() { return 2; }
    enum E implements F { P, Q }
    enum record { R }
    record Point(int x) {
    }
    @interface Mark {
    }
}
class Open {
"""
    assert found(text, False) == [
        ("type", "A", 2, 41),
        ("method", "A.make", 4, 10),
        ("method", "A.A", 13, 30),
        ("method", "A.Thread", 23, 26),
        ("method", "A.run", 24, 25),
        ("method", "A.go", 28, 28),
        ("method", "A.x", 34, 34),
        ("type", "A.E", 35, 35),
        ("type", "A.record", 36, 36),
        ("type", "A.Point", 37, 38),
        ("method", "A.Point", 37, 38),
    ]


def test_kotlin_heads():
    """Files without semicolons: heads begin on their own lines; receivers, delegation, values, heads without a body."""
    text = """package a

import b.C
val x = 1
@JvmStatic
private suspend inline fun <T> List<T>.second(
    f: (T) -> Int,
): Int? {
}
fun interface F {
    fun call(x: Int): String
}
enum class E(val v: Int) {
    A(1) {
    };
    internal constructor(x: String) : this(x.length) {
    }
    fun a() = g(1)
    fun b(): Int =
        2
    fun `with space`() {
    }
}
sealed class S
data class D(val a: Int)
object O : P {
    init
    {
    }
    companion object {
    }
    companion object Named { }
}
fun Map<A, B>.no() { }
"""
    assert found(text, True) == [
        ("method", "second", 5, 9),
        ("type", "F", 10, 12),
        ("method", "call", 11, 23),
        ("type", "E", 13, 23),
        ("method", "E.constructor", 16, 17),
        ("method", "E.a", 18, 18),
        ("method", "E.a", 18, 22),
        ("type", "S", 24, 33),
    ]


def test_mask_keeps_offsets():
    masked = declarations.mask(JAVA)
    assert len(masked) == len(JAVA) and masked.count("\n") == JAVA.count("\n") and "no()" not in masked


def test_every_line_is_in_a_chunk(spark):
    files = spark.createDataFrame(
        [
            ("A.java", "java", JAVA),
            ("K.kt", "kotlin", KOTLIN),
            ("C.smali", "smali", SMALI),
            ("t.txt", "text", "a\nb"),
            ("e.java", "java", ""),
            ("n.java", "java", None)
        ],
        "path string, language string, content string",
    )
    rows = declarations.chunks(files, size=3, overlap=1).collect()
    for path, text in (("A.java", JAVA), ("K.kt", KOTLIN), ("C.smali", SMALI), ("t.txt", "a\nb")):
        mine = [r for r in rows if r.path == path]
        lines = text.rstrip("\n").split("\n")
        assert {x for r in mine for x in range(r.start_line, r.end_line + 1)} == set(range(1, len(lines) + 1))
        assert all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in mine)
    smali = {
        r.symbol: (r.start_line, r.end_line, r.start_instruction, r.end_instruction)
        for r in rows
        if r.path == "C.smali" and r.kind == "method"
    }
    assert smali == {"a.b.C->run(I)V": (2, 6, 1, 2), "a.b.C->x()I": (8, 10, 3, 3)}


def test_manifest(spark, tmp_path):
    ns = 'xmlns:android="http://schemas.android.com/apk/res/android"'
    (tmp_path / "a.xml").write_text(
        f'<manifest {ns} package="p.q"><uses-sdk android:targetSdkVersion="30"/><application android:permission="P"><activity android:name=".Main"><intent-filter/></activity><provider android:name="x.Y" android:exported="true" android:readPermission="R"/><service android:name="S" android:enabled="false"/></application></manifest>'
    )
    (tmp_path / "b.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><manifest/>')
    (tmp_path / "c.xml").write_bytes(b"\x03\x00\x08\x00")
    rows = manifests.read(spark, str(tmp_path))
    assert sorted(r.problem for r in rows.where("problem is not null").collect()) == ["binary-xml", "document-type"]
    c = rows.where("problem is null").withColumn("sdk", manifest.target_sdk(F.col("target_sdk"), F.col("min_sdk")))
    state = manifest.export_state(manifest.inherit_permissions(c, F.col("application_permission")))
    got = {r.name: (r.exported, r.exported_source, r.effective_permission) for r in state.collect()}
    assert got == {
        "p.q.Main": (True, "inferred-from-intent-filter", "P"),
        "x.Y": (True, "explicit", "P"),
        "p.q.S": (False, "inferred-no-intent-filter", "P"),
    }
    assert {r.name for r in manifest.attack_surface(state).collect()} == {"p.q.Main", "x.Y"}


def test_whole_manifest(spark):
    """Permissions, features, filters with their data, flags, warnings, components with places, and files that are refused."""
    ns = 'xmlns:android="http://schemas.android.com/apk/res/android"'
    text = f"""<?xml version="1.0"?><manifest {ns} package="p.q" android:versionName="1.0">
      <uses-sdk android:minSdkVersion="x"/>
      <uses-permission android:name="android.permission.CAMERA" android:maxSdkVersion="q"/><uses-permission/>
      <uses-permission-sdk-23 android:name="b"/><uses-feature android:name="f"/><uses-feature android:name="f"/><uses-feature/>
      <application android:debuggable="@bool/d" android:allowBackup="FALSE" android:usesCleartextTraffic="@bool/c">
        <activity android:name="A"><intent-filter><action android:name="z"/><action android:name="a"/><category android:name="c"/>
          <data android:scheme="s" android:host="h"/><data android:path=" "/></intent-filter><intent-filter/></activity>
        <activity android:name="x.B" android:enabled="@bool/e" android:exported="true"/>
        <activity-alias/><service android:name="S" android:exported="@bool/s"/>
        <activity android:name=".C"><meta-data><intent-filter/></meta-data></activity>
      </application></manifest>"""
    files = spark.createDataFrame([("a", text.encode()), ("b", b"<!DOCTYPE x>"), ("c", b"\\x03"), ("d", b"<a/>"), ("e", b"<manifest"), ("f", None)], "file string, content binary")
    e = manifests.elements(files)
    assert {r.file: r.problem for r in e.where("problem is not null").collect()} == {"b": "document-type", "c": "binary-xml", "d": "no-manifest", "e": "malformed", "f": "binary-xml"}
    assert {tuple(r) for r in manifests.permissions(e).collect()} == {
        ("a", "android.permission.CAMERA", True, None, "/manifest/uses-permission[1]"),
        ("a", "<unnamed>", False, None, "/manifest/uses-permission[2]"),
        ("a", "b", False, None, "/manifest/uses-permission-sdk-23[1]"),
    }
    assert [tuple(r) for r in manifests.features(e).collect()] == [("a", "f")]
    f = {r.locator: (r.component, r.actions, r.categories, r.data) for r in manifests.filters(e).collect()}
    one = "/manifest/application/activity[1]"
    assert f == {f"{one}/intent-filter[1]": (one, ["a", "z"], ["c"], [{"host": "h", "scheme": "s"}, {}]), f"{one}/intent-filter[2]": (one, [], [], [])}
    h = manifests.heads(e).first()
    assert (h.package, h.version_name, h.debuggable, h.allow_backup, h.uses_cleartext_traffic, h.application_enabled) == ("p.q", "1.0", True, False, None, True)
    c = {r.locator.rsplit("/", 1)[1]: (r.kind, r.name, r.enabled, r.has_filter) for r in manifests.components(e).where("problem is null").collect()}
    assert c == {
        "activity[1]": ("activity", "p.q.A", True, True),
        "activity[2]": ("activity", "x.B", None, False),
        "activity[3]": ("activity", "p.q.C", True, False),
        "activity-alias[1]": ("activity-alias", "p.q.<unnamed>", True, False),
        "service[1]": ("service", "p.q.S", True, False),
    }
    w = [(r.locator.replace("/manifest/application", "~"), r.warning) for r in manifests.warnings(e).collect()]
    literal = "value '@bool/{}' is not a literal boolean; its effective value remains indeterminate without Android resource resolution."
    assert sorted(w) == sorted([
        ("~/@android:debuggable", literal.format("d")), ("~/@android:debuggable", manifests.TREATED), ("~/@android:usesCleartextTraffic", literal.format("c")),
        ("~/activity[2]/@android:enabled", literal.format("e")), ("~/service[1]/@android:exported", literal.format("s")),
        ("/manifest/uses-sdk[1]/@android:minSdkVersion", manifests.LEAST_SDK),
    ])
    assert not manifests.components(manifests.elements(files.limit(0))).collect()


def test_lines_of_lone_modifiers():
    """Runs of modifiers over many lines are read once: 400,000 lines in seconds, the same types and methods as for few."""
    for kotlin, words in ((False, ("static", "final", "public")), (True, ("open", "private", "data"))):
        tail = "class C {\n fun f() {\n }\n}\n" if kotlin else "class C {\n void f() {\n }\n}\n"
        few, many = ["\n".join((words * n)[:n]) + "\n" + tail for n in (5, 400_000)]
        began = time.time()
        got = found(many, kotlin)
        assert time.time() - began < 30
        assert [x[:2] for x in got] == [x[:2] for x in found(few, kotlin)] and ("type", "C") in [x[:2] for x in got]
        assert got[0][2:] == (1, 400_004)
    assert [x[1] for x in found("private\nenum\nclass A {\n}\nclass\nenum B {\n}\n", True)] == ["A", "enum"]

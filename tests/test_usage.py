"""Uses of kits' classes and the stubs that fit them, project files, and what reports show, on hand-made cases."""

from pyspark.sql import functions as F

from siltworks.operators import manifest, report, usage
from siltworks.sources import files

ONE = """import com.skt.sdk.Auth;
import com.nice.pay.Auth;
import com.nice.pay.Card ;
class A extends B implements Card, Runnable { }
Object a = new Auth( 12, 7L,3.5 , 2.5f, true, "s", null, new Foo(1), x);
Object b = new Auth();
Object c = new com.skt.sdk.Pin("a,b");
Object d = new Other(1);
"""
#: A literal's text and its type.
TYPES = {"12": "int", "7L": "long", "3.5": "double", "2.5f": "float", "true": "boolean", "false": "boolean", '"s': "String", "null": "Object", "new Foo(1": "Foo", "new Foo": "Foo", "x": "Object", "-1": "Object", "1.": "Object", "12\n": "Object"}


def test_literal_types(spark):
    df = spark.createDataFrame([(k,) for k in TYPES], "a string")
    assert {r[0]: r[1] for r in df.select("a", usage.literal_type(F.col("a"))).collect()} == TYPES


def test_import_map_takes_the_last_import(spark):
    got = {r.name: r.full_name for r in usage.import_map(spark.createDataFrame([("A.java", ONE)], "path string, content string")).collect()}
    assert got == {"Auth": "com.nice.pay.Auth", "Card": "com.nice.pay.Card"}


def test_usages(spark):
    df = spark.createDataFrame([("b/B.java", "import com.nice.pay.Auth;\nnew Auth(1); new Auth(); class X implements com.skt.sdk.Pin {"), ("a/A.java", ONE), ("c/C.kt", ONE.replace("12", "true")), ("d/D.java", None)], "path string, content string")
    got = {(r.package, r["class"]): (r.is_interface, r.constructors) for r in usage.usages(df).collect()}
    many = ["int", "long", "double", "float", "boolean", "String", "Object", "Foo"]
    assert got == {
        ("com.nice.pay", "Auth"): (False, [many, [], ["int"]]),
        ("com.nice.pay", "Card"): (True, []),
        ("com.skt.sdk", "Pin"): (True, [["String", "Object"]]),
    }
    assert usage.usages(df.limit(0)).count() == 0


def test_usage_stubs(spark):
    rows = [("p.q", "A", False, [["int", "String"], []]), ("p.q", "B", False, []), ("p.q", "C", True, [["int"]])]
    df = spark.createDataFrame(rows, "package string, class string, is_interface boolean, constructors array<array<string>>")
    a, b, c = (r[0] for r in df.orderBy("class").select(usage.usage_stub(F.col("package"), F.col("class"), F.col("is_interface"), F.col("constructors"))).collect())
    head = '/**\n * Auto-generated SDK stub for: p.q.{}\n * Generated based on actual usage patterns in app code.\n */\n@SuppressWarnings("unused")\n'
    assert a == "package p.q;\n\n" + head.format("A") + "public class A {\n\n    public A(int arg0, String arg1) {}\n    public A() {}\n\n}\n"
    assert b == "package p.q;\n\n" + head.format("B") + "public class B {\n\n    public B() {}\n\n    public B(android.content.Context context) {}\n\n}\n"
    assert c == "package p.q;\n\n" + head.format("C") + "public interface C {\n\n    // Interface stub - implement as needed\n    default void onEvent(Object... args) {}\n}\n"


def test_source_folder_and_project(spark, tmp_path):
    def made(name, *paths):
        for p in paths:
            at = tmp_path / name / p
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text("x")
        return str(tmp_path / name)

    whole = made("whole", "app/src/main/java/a/A.java", "app/build.gradle")
    assert files.source_folder(spark, whole) == whole + "/app/src/main/java" and files.is_project(spark, whole)
    flat = made("flat", "A.java", "a/B.java", "build.gradle")
    assert files.source_folder(spark, flat) == flat and files.is_project(spark, flat)
    deep = made("deep", "b/C.java", "a/x/B.java", "n.txt")
    assert files.source_folder(spark, deep).endswith("/deep/a/x") and not files.is_project(spark, deep)
    assert files.source_folder(spark, made("none", "n.txt")) is None and files.source_folder(spark, str(tmp_path / "absent")) is None


def test_shown(spark):
    df = spark.range(20).select(F.col("id").alias("n"))
    assert [r.n for r in report.shown(df, "warnings", "n").collect()] == [0, 1, 2, 3, 4]
    assert report.shown(df, "warnings", "n", every=True).count() == 20
    assert spark.range(1).select(report.shown_output(F.lit("é" * 501))).first()[0] == "é" * 500


def test_properties(spark):
    assert spark.range(1).select(manifest.properties_text()).first()[0].split("\n")[1:3] == ["org.gradle.parallel=true", "android.useAndroidX=true"]

"""Rewrites of a file's lines on hand-made files; what is expected is written out, not computed."""

import textwrap

import pytest
from pyspark.sql import functions as F

from siltworks.operators import extract, rewrite, sequences


def text(s):
    return textwrap.dedent(s).strip("\n")


def test_static_blocks_in_interfaces():
    before = text("""
        public interface A {
            int X = 1;
            static {
                go();
                if (x) { y(); }
            }
            void f();
        }
        class B {
            static { z(); }
        }""")
    after = text("""
        public interface A {
            int X = 1;
            // JADX FIX: Static initializer not allowed in interface
                // go();
                // if (x) { y(); }
            // }
            void f();
        }
        class B {
            // JADX FIX: Static initializer not allowed in interface
        }""")
    # The block's closing brace isn't counted for the interface, which therefore goes on below its end.
    assert sequences.interface_static_blocks(before) == after
    assert sequences.interface_static_blocks("class B {\n  static { z(); }\n}") == "class B {\n  static { z(); }\n}"
    assert sequences.interface_static_blocks("public interface A { }\nclass C {\n} }\nstatic { a(); }") == "public interface A { }\nclass C {\n} }\nstatic { a(); }"


def test_orphaned_code_up_to_the_next_member():
    before = text("""
        // JADX FIX: Static initializer not allowed in interface
            go();

            x = new Runnable() {
                public void run() {
                }
            };
            // a note
            public void next(int a) {
                stays();
            }""")
    after = text("""
        // JADX FIX: Static initializer not allowed in interface
            // ORPHANED: go();

            // ORPHANED: x = new Runnable() {
                // ORPHANED: public void run() {
                // ORPHANED: }
            // ORPHANED: };
            // a note
            public void next(int a) {
                stays();
            }""")
    assert sequences.orphaned_code(before) == after
    assert sequences.orphaned_code("// JADX FIX: Static initializer\n}\nstays();") == "// JADX FIX: Static initializer\n// ORPHANED: }\nstays();"
    assert sequences.orphaned_code("// JADX FIX: Static initializer\na();\n/* JADX WARN */\nb();") == "// JADX FIX: Static initializer\n// ORPHANED: a();\n/* JADX WARN */\nb();"
    assert sequences.orphaned_code("a\r\nb") == "a\r\nb"


def test_incomplete_calls():
    before = text("""
        void f() {
            box.call(
            /* JADX ERROR: lost */
            int left = 1;

            // kept
            throw new UnsupportedOperationException("n");
        }
        g(
        */
        /* JADX WARN: */
        throw new UnsupportedOperationException();""")
    after = text("""
        void f() {
            // JADX FIX: Incomplete method call removed
            // /* JADX ERROR: lost */
            // int left = 1;

            // kept
            throw new UnsupportedOperationException("n");
        }
        g(
        */
        /* JADX WARN: */
        throw new UnsupportedOperationException();""")
    assert sequences.incomplete_calls(before) == after
    far = lambda n: "\n".join(["f(", "// JADX ERROR:", *["x"] * n, "throw new UnsupportedOperationException();"])
    assert sequences.incomplete_calls(far(97)) != far(97) and sequences.incomplete_calls(far(98)) == far(98)


def test_undeclared_arrays():
    before = "// int[] a = new int[(b).length() + 1];\n  a[i] = 1; c[j] = 2;\na[k] = 3;\nint[] d = x; d[0] = 1;\nString e = f; e[0] = 1;"
    after = "\n".join(["// int[] a = new int[(b).length() + 1];", "  a[i] = 1; c[j] = 2;", "a[k] = 3;", "int[] d = x; d[0] = 1;", "String e = f; e[0] = 1;"])
    made = sequences.undeclared_arrays(before).split("\n")
    # The commented line declares a for the search of declarations, as it is not told apart from code.
    assert made[1:5] == ["  // JADX FIX: Added missing array declaration", "  int[] c = new int[256];", "  a[i] = 1; c[j] = 2;", "a[k] = 3;"] and after.split("\n")[0] == made[0]
    sized = sequences.undeclared_arrays("x(); // a new int[(b).length()] was here\na[i] = 1;")
    assert sized == "x(); // a new int[(b).length()] was here\n// JADX FIX: Added missing array declaration\nint[] a = new int[256];\na[i] = 1;"


@pytest.mark.parametrize(
    ("line", "is_one"),
    [
        ("public int f(int a) {", True), ("public int f(int a) throws E, G {", True), ("static <T> List<T> g() {", True), ("public Foo(int a) {", False), ("class A { int f() {", False),
        ("public static class B { C d() {", False), ("int f(int a) {", False), ("private int x = y(z);", False), ("public boolean ready(int n) { return true; }", True),
    ],
)
def test_method_declarations(spark, line, is_one):
    assert sequences.is_method(line) == is_one
    assert spark.createDataFrame([("  " + line,)], "line string").select(rewrite.is_method(F.col("line"))).first()[0] == is_one


def spans(spark, lines):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    return sorted((r.line_no, r.end_no) for r in rewrite.method_spans(df).collect())


def test_method_spans(spark):
    lines = ["public class A {", "  public int f() { return 1; }", "  private void g(int x) {", "    // }", "  }", '  public void h() { s("}"); c(\'{\');', "  }", "}"]
    # The brace in the comment ends g where it stands; those in strings and characters don't count.
    wanted = [(1, 1), (2, 3), (5, 6)]
    assert spans(spark, lines) == wanted
    assert [(i, sequences.method_end(lines, i)) for i, x in enumerate(lines) if sequences.is_method(x.strip())] == wanted
    assert spans(spark, ["public int f() {", "}}", "{"]) == [(0, 2)]


def test_method_stubbing():
    before = text("""
        class A {
            public int f(int a) {
                foo(a);
            }
            public List<String> g() {
                return ( ) , x;
            }
            private void h() {
                fine();
            }
            static boolean k() { bad(x); }
        }""")
    after = text("""
        class A {
            public int f(int a) {
                // TODO: Decompilation failed - method body could not be restored
                // Original method contained invalid bytecode patterns (R8 optimization)
                return 0;
            }
            public List<String> g() {
                // TODO: Decompilation failed - method body could not be restored
                // Original method contained invalid bytecode patterns (R8 optimization)
                return null;
            }
            private void h() {
                fine();
            }
            static boolean k() { bad(x); }
        }""")
    assert sequences.stub_methods(before) == after
    assert sequences.stub("  protected void f() throws E {")[1:] == ["      " + n for n in sequences.STUB_NOTES] + ["  }"]
    assert [sequences.stub(f"public {t} f() {{")[3] for t in ("boolean", "long", "double", "int[]", "Foo")] == ["    return false;", "    return 0;", "    return 0.0;", "    return null;", "    return null;"]


def test_unreachable_text_agrees_with_the_window(spark):
    lines = ["a();", "return 1;", "dead();", "", "// note", "return 2;", "} else {", "live();", "throw x;", "dead();", "case 1:", "go();", "return;", "catch (E e)", "x"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    marked = {r.line_no for r in rewrite.unreachable(df).filter("dead").collect()}
    assert sequences.unreachable("\n".join(lines)).split("\n") == [f"// UNREACHABLE: {x}" if i in marked else x for i, x in enumerate(lines)] and marked == {2, 5, 9}


def one(spark, f, content):
    return spark.createDataFrame([(content,)], "c string").select(f(F.col("c"))).first()[0]


def test_whole_file_rules(spark):
    assert one(spark, rewrite.cast_bitwise, "int m = (a & 3) + (b | 4); x = (a & 3) + c;") == "int m = (int)((a & 3) + (b | 4)); x = (a & 3) + c;"
    fields = "public interface A {\n public static final String S;\n static final long L;\npublic  static final char C ;\nstatic final Foo F;\nstatic final float G;\nstatic final int H = 1;\n}"
    made = "public interface A {\n public static final String S = \"\";\n static final long L = 0;\npublic  static final char C = '\\0';\nstatic final Foo F = null;\nstatic final float G = 0.0f;\nstatic final int H = 1;\n}"
    assert one(spark, rewrite.interface_fields, fields) == made
    assert one(spark, rewrite.interface_fields, fields.replace("interface", "class")) == fields.replace("interface", "class")
    assert one(spark, rewrite.int_ternaries, "s = i == true ? 1 : 0; (int) ( j == true ? 1 : 0 )") == "s = (i != 0) ? 1 : 0; ((j != 0) ? 1 : 0)"
    assert one(spark, rewrite.int_booleans, "if (a == trueish || b != false)") == "if (a != 0ish || b != 0)"
    assert one(spark, rewrite.insert_imports, "/* h */ package a;\nclass B { Uri u; Log l; }") == "/* h */ package a;\n\nimport android.util.Log;\nimport android.net.Uri;\nclass B { Uri u; Log l; }"
    assert one(spark, rewrite.insert_imports, "package a\nUri u") == "\n\nimport android.net.Uri;package a\nUri u"
    assert one(spark, rewrite.insert_imports, "class B { Uri u; }") == "class B { Uri u; }"


def test_all_passes_and_counts(spark):
    bad = "package a;\nclass B {\n  void f() {\n    if (x == true) {\n    return 1;\n    y();\n"
    rows = {r.path: r for r in rewrite.fix_files(spark.createDataFrame([("a", bad), ("b", "class C {\n}"), ("c", None), ("d", "")], "path string, content string")).collect()}
    assert rows["a"].fixed == "package a;\nclass B {\n  void f() {\n    if (x != 0) {\n    return 1;\n// UNREACHABLE:     y();\n}\n}\n}\n" and rows["a"].n_fixes == 3
    assert (rows["b"].fixed, rows["b"].n_fixes, rows["c"].fixed, rows["d"].fixed) == ("class C {\n}", 0, None, "")


def test_degradation(spark):
    files = [("many", "x(y);" * 50), ("few", "class A {\n  public int f() {\n    x(y);\n  }\n}"), ("none", "class B {}")]
    rows = {r.path: r for r in rewrite.degrade(spark.createDataFrame(files, "path string, content string")).collect()}
    assert set(rows) == {"few", "none"} and rows["few"].n_stubbed == 1 and rows["none"].content == "class B {}"
    assert one(spark, rewrite.invalid_patterns, "illegal start of type; class, interface, enum, or record expected; x( y );") == 3


def test_lost_methods(spark):
    files = spark.createDataFrame([("f", "ab(12, x, y); o.cd(1, z); mo5x(); m7(a, b); xxab(1, 2); ef(1,a,b,c,d,e,f,g,h,i,j,k)")], "path string, content string")
    assert sorted(tuple(r) for r in extract.lost_methods(files).collect()) == [("ab", 3), ("ef", 10), ("m7", 3), ("mo5x", 0)]

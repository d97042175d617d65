"""A source-code corpus derived from the part table, by expressions that Spark and DuckDB read alike.

The driver's tables hold no source code; this stands in for a scanned source tree. Operators take any DataFrame of
(path, content), such as siltworks.sources.files.source_files() gives.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.session import table

K = "p_partkey"
_IMPORTS = ("okhttp3.OkHttpClient", "retrofit2.Retrofit", "dagger.hilt.android.Foo", "androidx.core.app.ActivityCompat", "androidx.appcompat.app.AppCompatActivity", "com.google.firebase.auth.Token", "kotlinx.coroutines.flow.Flow", "com.acme.tools.Kit", "java.util.List", "io.reactivex.Observable", "com.acme.gadget.Box", "androidx.room.Database")
_SECOND = ("static com.airbnb.lottie.Lottie.make", "androidx.work.*", "com.skt.sdk.Auth", "com.nice.pay.Card", "timber.log.Timber", "android.util.Log", "org.apache.poi.Sheet", "com.visa.checkout.Button")


def _case(expr: str, values: tuple[str, ...]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _when(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} END"


_NL = "chr(10)"
_FOLDER = f"CASE WHEN {K} % 31 <> 3 THEN concat('src/com/acme/m', {K} % 7, CASE WHEN {K} % 3 = 0 THEN '/ui' ELSE '' END) WHEN {K} % 3 = 0 THEN 'out/sources/p012okhttp' WHEN {K} % 3 = 1 THEN 'out/sources/a' ELSE 'out/sources/org/jsonic/deep' END"
_FILE = f"CASE WHEN {K} % 47 = 1 THEN 'R$id.java' WHEN {K} % 47 = 2 THEN 'BuildConfig.java' ELSE concat('F', {K}, CASE WHEN {K} % 11 = 5 THEN '.kt' ELSE '.java' END) END"
PATH = f"concat({_FOLDER}, '/', CASE WHEN {K} % 47 IN (1, 2) THEN concat('f', {K}, '/') ELSE '' END, {_FILE})"
_END = f"CASE WHEN {K} % 11 = 5 THEN ' as Alias' ELSE ';' END"
_LINES = (
    _when(f"{K} % 4 = 2", "'/* a head */'"),
    _when(f"{K} % 31 <> 3", f"concat('package ', CASE WHEN {K} % 13 = 6 THEN 'com.visa.m' WHEN {K} % 13 = 7 THEN 'p99gson.m' ELSE 'com.acme.m' END, {K} % 7, CASE WHEN {K} % 3 = 0 THEN '.ui' ELSE '' END, ';')"),
    "''",
    f"concat('import ', {_case(f'{K} % {len(_IMPORTS)}', _IMPORTS)}, {_END})",
    f"concat('import ', {_case(f'{K} % {len(_SECOND)}', _SECOND)}, {_END})",
    _when(f"{K} % 6 <> 2", f"concat('// file ', {K})"),
    f"concat('public class ', CASE {K} % 5 WHEN 0 THEN 'a' WHEN 1 THEN concat('Order', {K}) WHEN 2 THEN 'ab' WHEN 3 THEN 'C0012x' ELSE 'ItemListener' END, ' {{')".replace("{{", "{"),
    _when(f"{K} % 8 = 2", "'    public static final int SIZE;'"),
    f"concat('    private int ', CASE {K} % 3 WHEN 0 THEN 'get' ELSE 'computeTotal' END, '(View v) ' || chr(123))",
    _when(f"{K} % 3 = 0", "'        flag(ready == true, done != false);'"),
    _when(f"{K} % 6 = 1", "'        call( , 1, );'"),
    _when(f"{K} % 10 = 0", "'        ?? item;'"),
    _when(f"{K} % 11 = 0", "'        // JADX ERROR: Method load error'"),
    _when(f"{K} % 7 = 4", "'        String s = \"{ // \";'"),
    f"CASE WHEN {K} % 4 = 1 THEN '        throw new Error(x);' ELSE '        return 1;' END",
    _when(f"{K} % 4 < 2", "'        int dead = 2;'"),
    _when(f"{K} % 8 = 5", "'        Log.d(tag);'"),
    _when(f"{K} % 9 = 5", "'        total[i] = 3;'"),
    _when(f"{K} % 9 = 6", "'        int[] total = new int[4]; total[i] = 3;'"),
    _when(f"{K} % 10 = 3", "'        com.skt.sdk.AuthListener.go(com.nice.pay.Card.make());'"),
    _when(f"{K} % 16 = 2", "'        Auth one = new Auth(12, \"x\", 3.5f, true); go(new com.nice.pay.Card(7L , null, one));'"),
    _when(f"{K} % 16 = 11", "'        Object pay = new Card( new Box(1), 2.5);'"),
    _when(f"{K} % 24 = 3", "concat('        class Local implements Card, Runnable ', chr(123), ' ', chr(125))"),
    _when(f"{K} % 6 = 4", "'        ab(12, x, y);'"),
    _when(f"{K} % 12 = 7", "'        mo15run(z); String k = new String(new byte[2]);'"),
    _when(f"{K} % 14 = 2", "'        int m = (a & 3) + (b | 4);'"),
    _when(f"{K} % 23 = 1", "'        // illegal start of expression'"),
    _when(f"{K} % 29 = 0", "'        Binding.inflate(one, two);'"),
    _when(f"{K} % 40 = 7", "repeat('x(y); ', 60)"),
    "concat('    ', chr(125))",
    _when(f"{K} % 7 = 2", "concat('    public boolean ready(int n) ', chr(123), ' return true; ', chr(125))"),
    _when(f"{K} % 13 <> 0", "chr(125)"),
    _when(f"{K} % 17 = 3", f"concat('public interface Holder ', chr(123), {_NL}, '    public static final String NAME;', {_NL}, '    static final int N;', {_NL}, '    static ', chr(123), {_NL}, '        int a = 1;', {_NL}, '    ', chr(125), {_NL}, chr(125))"),
    _when(f"{K} % 19 = 4", f"concat('        box.call(', {_NL}, '        /* JADX ERROR: lost */', {_NL}, '        int left = 1;', {_NL}, '        throw new UnsupportedOperationException(x);')"),
)
CONTENT = f"concat_ws({_NL}, {', '.join(_LINES)})"
#: CTEs for DuckDB: corpus(path, content) and lines(path, line_no, line).
SQL = f"""corpus AS (SELECT {PATH} AS path, {CONTENT} AS content FROM part),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM corpus)"""


#: Files that one task makes of the table: at most so many, and fewer where the tasks would be too few for the cores.
TASK_FILES, LEAST_FILES = 20_000, 500


def dealt_parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the part table, p_partkey among them, dealt to tasks by the number of rows.

    A row has a few bytes where the file made of it has a thousand, so the splits of the stored table are far too large.
    """
    parts = table(spark, sf_dir, "part").select(K, *columns)
    n = parts.count()  # of the footers alone
    return parts.repartition(max(1, math.ceil(n / TASK_FILES), min(4 * spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_FILES))), K)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_parts(spark, sf_dir).select(F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"))


#: What a search for a simple class name finds, in its order: name, ord, group, artifact, version. Hand-made.
LOOKUP = (
    ("Kit", 0, "org.eclipse.kit", "kit-core", "1.0"), ("Kit", 1, "com.acme", "kit", "2.1"), ("Box", 0, "io.acme.swing", "box", "0.1"), ("Box", 1, "io.acme", "box", "0.2"), ("Box", 2, "io.acme", "box-extra", "0.3"),
    ("Sheet", 0, "org.apache.poi", "poi", "5.2"), ("Card", 0, "com.google.android.awt", "card", "1.1"), ("Auth", 0, "net.javaee.auth", "auth", "3.0"), ("Button", 0, "com.acme.visa", "button", "1.4"),
)


def lookup(spark: SparkSession) -> DataFrame:
    """LOOKUP as a table, written into the plan."""
    rows = ", ".join(f"('{n}', {i}, '{g}', '{a}', '{v}')" for n, i, g, a, v in LOOKUP)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, ord, group_id, artifact_id, version)")

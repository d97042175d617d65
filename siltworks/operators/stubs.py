"""References to vendors' kits and the stubs that stand in for them, and stubs of lost methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators.extract import under_prefixes
from siltworks.operators.organize import prefix_table


def is_interface(name: Column) -> Column:
    """Whether a class's name is an interface's by convention."""
    return name.rlike(fixed.INTERFACE_NAME)


def references(files: DataFrame) -> DataFrame:
    """(path, package, class, is_interface, kind): kit classes that files import (0), by wildcard (1), or name in full (2).

    A wildcard stands for a class PackageInfo. Only imports tell interfaces apart.
    """
    every = lambda pattern, group: F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
    name = F.col("name")
    plain = files.select("path", F.explode(every(fixed.SDK_IMPORT, 1)).alias("name")).filter(name.contains("."))
    plain = plain.select("path", F.regexp_extract(name, r"^(.*)\.", 1).alias("package"), F.substring_index(name, ".", -1).alias("class"), name.alias("full"), F.lit(0).alias("kind"))
    wild = files.select("path", F.explode(every(fixed.SDK_WILDCARD, 1)).alias("package")).select("path", "package", F.lit("PackageInfo").alias("class"), F.col("package").alias("full"), F.lit(1).alias("kind"))
    named = files.select("path", F.explode(F.arrays_zip(every(fixed.QUALIFIED, 1).alias("p"), every(fixed.QUALIFIED, 2).alias("c"))).alias("x"))
    named = named.select("path", F.col("x.p").alias("package"), F.col("x.c").alias("class"), F.col("x.p").alias("full"), F.lit(2).alias("kind"))
    rows = under_prefixes(plain.unionByName(wild).unionByName(named), "full", prefix_table(files.sparkSession, fixed.SDK_PACKAGES), True)
    return rows.select("path", "package", "class", ((F.col("kind") == 0) & is_interface(F.col("class"))).alias("is_interface"), "kind").distinct()


def classes(refs: DataFrame) -> DataFrame:
    """(package, class, is_interface): the first reference of each class, by path, imports before full names."""
    return refs.groupBy("package", "class").agg(F.min_by("is_interface", F.struct("path", "kind")).alias("is_interface"))


def totals(stubs: DataFrame) -> DataFrame:
    return stubs.agg(F.countDistinct("package").alias("n_packages"), F.count_if(~F.col("is_interface")).alias("n_classes"), F.count_if("is_interface").alias("n_interfaces"))


def _member(note: str, *code: str) -> str:
    return "\n".join(["    /**", f"     * {note}", "     */", *[f"    {c}" for c in code]])


def _returning(note: str, head: str, value: str) -> str:
    return _member(note, f"public {head} {{", f"    return {value};", "}")


#: Members of a class's stub; {class} is its name. Fixed values.
CLASS_MEMBERS = (
    _member("Default constructor stub", "public {class}() {", "    // Stub constructor", "}"),
    _member("Constructor with context (common Android pattern)", "public {class}(android.content.Context context) {", "    // Stub constructor", "}"),
    _returning("Generic method stub - returns null for objects", "Object invoke(Object... args)", "null"),
    _returning("Generic method stub - returns empty string", "String getString()", '""'),
    _returning("Generic method stub - returns 0", "int getInt()", "0"),
    _returning("Generic method stub - returns false", "boolean getBoolean()", "false"),
)
_SUCCESS = _member("Success callback stub", "default void onSuccess(Object result) {}")
#: Members of an interface's stub by the end of its name; the last for all others. Fixed values.
INTERFACE_MEMBERS = (
    ("Listener", (_member("Callback method stub", "void onEvent(Object... args);"), _SUCCESS, _member("Error callback stub", "default void onError(Exception error) {}"))),
    ("Callback", (_member("Callback method stub", "void onCallback(Object... args);"), _SUCCESS, _member("Failure callback stub", "default void onFailure(Exception error) {}"))),
    ("Handler", (_member("Handle method stub", "void handle(Object... args);"),)),
    ("Observer", (_member("Update method stub", "void onUpdate(Object... args);"),)),
    ("", (_member("Generic interface method stub", "default void execute(Object... args) {}"),)),
)
ENUM_MEMBERS = ("    UNKNOWN;", _returning("Generic value getter stub", "int getValue()", "0"))
_FRAME = """package {{package}};

/**
 * Auto-generated stub {kind} for SDK: {{package}}.{{class}}
 * This stub allows compilation when the actual SDK is not included.
 */
@SuppressWarnings("unused")
public {kind} {{class}} {{{{
{members}
}}}}

"""


def template(kind: str, members: tuple[str, ...]) -> str:
    """The stub of a class, interface or enum, with {package} and {class} to be filled in."""
    lead = "" if kind == "enum" else "\n"
    return _FRAME.format(kind=kind, members=lead + "\n\n".join(members)).replace("{{", "{").replace("}}", "}")


def _text(kind: str, members: tuple[str, ...], package: Column, name: Column) -> Column:
    return F.replace(F.replace(F.lit(template(kind, members)), F.lit("{package}"), package), F.lit("{class}"), name)


def stub_text(package: Column, name: Column, kind: Column) -> Column:
    """The stub of a class, interface or enum."""
    interface = None
    for end, members in INTERFACE_MEMBERS:
        text = _text("interface", members, package, name)
        interface = (F if interface is None else interface).when(name.endswith(end), text) if end else interface.otherwise(text)
    return F.when(kind == "interface", interface).when(kind == "enum", _text("enum", ENUM_MEMBERS, package, name)).otherwise(_text("class", CLASS_MEMBERS, package, name))


def stub_files(stubs: DataFrame) -> DataFrame:
    """(path, content) of the stubs of classes()."""
    kind = F.when(F.col("is_interface"), "interface").otherwise("class")
    path = F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/"), F.col("class"), F.lit(".java"))
    return stubs.select(path.alias("path"), stub_text(F.col("package"), F.col("class"), kind).alias("content"))


#: The class that holds the stubs of lost methods. Fixed values.
LOST_HEAD = """package decompiler_stubs;

/**
 * Auto-generated stub class for missing obfuscated methods.
 */
@SuppressWarnings("unused")
public class DecompilerStubs {

"""


def lost_method_class(methods: DataFrame) -> DataFrame:
    """(n, content): the number of methods (name, n_args) and one class with all of them, by name and arguments; no row without any.

    The class is one file by its nature, so its text is built in one place; the methods are distinct pairs of short
    names and at most ten arguments.
    """
    arguments = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i < F.col("n_args")), lambda i: F.concat(F.lit("Object arg"), i.cast("string"))), ", ")
    text = F.concat(F.lit("    public static Object "), F.col("name"), F.lit("("), arguments, F.lit(') {\n        throw new UnsupportedOperationException("Stub method: '), F.col("name"), F.lit('");\n    }\n\n'))
    rows = methods.select(F.struct("name", "n_args", text.alias("text")).alias("m"))
    made = rows.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["text"]), "").alias("body"))
    return made.filter("n > 0").select("n", F.concat(F.lit(LOST_HEAD), "body", F.lit("}\n")).alias("content"))

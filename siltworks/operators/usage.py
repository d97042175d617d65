"""How sources use vendors' classes: constructors called, interfaces implemented, and stubs made to fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators.extract import under_prefixes
from siltworks.operators.organize import prefix_table


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def imported(content: Column) -> Column:
    """Full names that a file imports, in its order."""
    return F.regexp_extract_all(content, F.lit(fixed.USAGE_IMPORT), F.lit(1))


def full_name(name: Column, imports: Column) -> Column:
    """A name with its package: as it is if it has one, else that of the file's last import of it; null without."""
    match = F.filter(imports, lambda i: F.substring_index(i, ".", -1) == name)
    return F.when(name.contains("."), name).otherwise(F.try_element_at(match, F.lit(-1)))


def import_map(files: DataFrame) -> DataFrame:
    """(path, name, full_name): what each simple name stands for in a file; the last import of a name counts."""
    rows = files.select("path", F.posexplode(imported(F.col("content"))).alias("pos", "full_name"))
    return rows.groupBy("path", F.substring_index("full_name", ".", -1).alias("name")).agg(F.max_by("full_name", "pos").alias("full_name"))


def literal_type(expression: Column) -> Column:
    """The type that an argument's text tells; Object where it tells none."""
    made = stripped(F.substring_index(F.regexp_replace(expression, "^.*?new ", ""), "(", 1))
    return (
        F.when(expression.rlike(r"^\d+\z"), "int").when(expression.rlike(r"^\d+L\z"), "long").when(expression.rlike(r"^\d+\.\d+\z"), "double")
        .when(expression.rlike(r"^\d+\.\d+f\z"), "float").when(expression.isin("true", "false"), "boolean").when(expression.startswith('"'), "String")
        .when(expression.startswith("new "), made).otherwise("Object")
    )


def usages(files: DataFrame) -> DataFrame:
    """(package, class, is_interface, constructors) of the kits' classes that Java files construct or implement.

    constructors: each list of argument types once, by the first path and place that has it. Arguments end at the
    first closing bracket and are split at every comma, as the text stands. Imports are looked up within the row, so
    only the uses of kits' classes are shuffled, and each list of types only once a task.
    """
    java = files.filter(F.col("path").endswith(".java")).select("path", "content", imported(F.col("content")).alias("imports"))
    every = lambda pattern, group: F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
    calls = java.select("path", "imports", F.posexplode(F.arrays_zip(every(fixed.NEW_INSTANCE, 1).alias("n"), every(fixed.NEW_INSTANCE, 2).alias("a"))).alias("pos", "x"))
    arguments = F.filter(F.transform(F.split(F.col("x.a"), ","), stripped), lambda a: a != "")
    made = calls.select(full_name(F.col("x.n"), F.col("imports")).alias("full"), F.struct("path", "pos").alias("at"), F.transform(arguments, literal_type).alias("types"))
    lists = java.select("imports", F.explode(every(fixed.IMPLEMENTS, 1)).alias("names"))
    names = lists.select("imports", F.explode(F.split("names", ",")).alias("name"))
    kept = names.select(full_name(stripped(F.col("name")), F.col("imports")).alias("full"), F.lit(None).cast("struct<path:string,pos:int>").alias("at"), F.lit(None).cast("array<string>").alias("types"))
    rows = under_prefixes(made.unionByName(kept).filter(F.col("full").isNotNull()), "full", prefix_table(files.sparkSession, fixed.SDK_PACKAGES), True)
    once = rows.groupBy("full", "types").agg(F.min("at").alias("at"))
    found = once.groupBy("full").agg(F.bool_or(F.col("types").isNull()).alias("is_interface"), F.array_sort(F.collect_list(F.when(F.col("types").isNotNull(), F.struct("at", "types")))).alias("made"))
    return found.select(F.regexp_extract("full", r"^(.*)\.", 1).alias("package"), F.substring_index("full", ".", -1).alias("class"), "is_interface", F.transform("made", lambda m: m["types"]).alias("constructors"))


#: The parts of a stub; {package}, {class} and {constructors} are filled in. Fixed values.
HEAD = """package {package};

/**
 * Auto-generated SDK stub for: {package}.{class}
 * Generated based on actual usage patterns in app code.
 */
@SuppressWarnings("unused")
"""
INTERFACE = """public interface {class} {

    // Interface stub - implement as needed
    default void onEvent(Object... args) {}
}
"""
CLASS = """public class {class} {

{constructors}

}
"""
PLAIN_CONSTRUCTORS = """    public {class}() {}

    public {class}(android.content.Context context) {}"""


def usage_stub(package: Column, name: Column, is_interface: Column, constructors: Column) -> Column:
    """The stub of a class with the constructors that are called, or of an interface."""
    parameters = lambda types: F.array_join(F.transform(types, lambda t, i: F.concat(t, F.lit(" arg"), i.cast("string"))), ", ")
    each = F.transform(constructors, lambda types: F.concat(F.lit("    public {class}("), parameters(types), F.lit(") {}")))
    body = F.when(F.size(constructors) > 0, F.array_join(each, "\n")).otherwise(F.lit(PLAIN_CONSTRUCTORS))
    text = F.when(is_interface, F.lit(HEAD + INTERFACE)).otherwise(F.replace(F.lit(HEAD + CLASS), F.lit("{constructors}"), body))
    return F.replace(F.replace(text, F.lit("{package}"), package), F.lit("{class}"), name)

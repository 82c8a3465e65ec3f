"""Column functions over file paths and module names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance given to modules that are no files.
NO_FILE_DISTANCE = 4


def is_python_file(path: Column) -> Column:
    return path.rlike(r"\.pyi?$")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; '' if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def module_basename(path: Column) -> Column:
    """Name of the module a file holds: its name up to the first dot, or the directory's name for a package's __init__."""
    parts = F.split(path, "/")
    package = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return F.when(file_name(path).isin("__init__.py", "__init__.pyi"), package).otherwise(F.substring_index(file_name(path), ".", 1))


def dotted_module(path: Column) -> Column:
    """Dotted module name of a relative path; packages give the name of their directory."""
    plain = F.translate(F.regexp_replace(path, r"/__init__\.pyi?$", ""), "/", ".")
    folder = directory(path)
    named = F.when(folder == "", F.substring_index(file_name(path), ".", 1)).otherwise(F.concat(F.translate(folder, "/", "."), F.lit("."), F.substring_index(file_name(path), ".", 1)))
    return F.when(path.rlike(r"(^|/)__init__\.pyi?$"), plain).otherwise(named)


def join_attribute(module: Column, attribute: Column) -> Column:
    """module.attribute, with no further dot after one that ends the module."""
    return F.when(module.endswith("."), F.concat(module, attribute)).otherwise(F.concat(module, F.lit("."), attribute))


def relative_module_path(name: Column) -> Column:
    """'..a.b' gives '../a/b', '.a' './a', '.' '.', and 'a.b' 'a/b'."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(name, r"^\.+", ""), ".", "/")
    up = F.when(dots == 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    return F.when(name == ".", F.lit(".")).otherwise(F.concat(up, rest))


def shorten_path(path: Column) -> Column:
    """The first letter of each piece between slashes and underscores; the last segment stays whole."""
    parts = F.split(path, "/")
    short = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.array_join(F.transform(F.split(p, "_"), lambda x: F.substring(x, 1, 1)), "_"))
    return F.when(F.size(parts) == 1, path).otherwise(F.concat(F.array_join(short, "/"), F.lit("/"), F.element_at(parts, -1)))


def beginnings(path: Column) -> Column:
    """The path up to each of its components: '/a/b' gives '', '/a' and '/a/b'."""
    return F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.call_function("substring_index", path, F.lit("/"), i))


def distance_between(a: Column, b: Column) -> Column:
    """file_distance of two paths given by their beginnings, which cost more than this and can be made before a join."""
    return F.greatest(F.size(a), F.size(b)) - F.size(F.array_intersect(a, b))


def file_distance(a: Column, b: Column) -> Column:
    """Components left on the longer path once the common beginning of both is taken away."""
    return distance_between(beginnings(a), beginnings(b))


def join_names(*names: Column) -> Column:
    """Dotted join that leaves out null and empty names."""
    return F.concat_ws(".", *[F.when(n != "", n) for n in names])


def as_directory(path: Column, is_dir: Column) -> Column:
    return F.when(is_dir & ~path.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)


def ancestors(path: Column) -> Column:
    """All directories above a path, each with its final slash, from the root down."""
    above = F.regexp_replace(path, "/[^/]*/?$", "")
    return F.transform(beginnings(above), lambda x: F.concat(x, F.lit("/")))


def strip_underscores(name: Column) -> Column:
    return F.ltrim(name, F.lit("_"))


def module_stems(path: Column) -> Column:
    """(stem, form) structs: the extensionless module paths a file may hold, with the place it has among the files that may hold them: a
    package's stub, a package, a module, a module's stub. Other files hold none."""
    one = lambda stem, form: F.struct(stem.alias("stem"), F.lit(form).alias("form"))
    plain, folder = F.regexp_replace(path, r"\.pyi?$", ""), directory(path)
    own = F.when(path.endswith(".py"), F.array(one(plain, 2))).when(path.endswith(".pyi"), F.array(one(plain, 3)))
    package = F.when(path.endswith("/__init__.pyi"), F.array(one(folder, 0))).when(path.endswith("/__init__.py"), F.array(one(folder, 1)))
    return F.concat(F.coalesce(own, F.slice(F.array(one(plain, 2)), 1, 0)), F.coalesce(package, F.slice(F.array(one(plain, 2)), 1, 0)))


def import_statement(module: Column, value: Column, as_name: Column) -> Column:
    alias = F.when(as_name.isNotNull() & (as_name != ""), F.concat(F.lit(" as "), as_name)).otherwise(F.lit(""))
    return F.when(value.isNull() | (value == ""), F.concat(F.lit("import "), module, alias)).otherwise(F.concat(F.lit("from "), module, F.lit(" import "), value, alias))


def number_literal(text: Column) -> Column:
    """Value of a whole number in Python's spelling (decimal, 0x, 0o, 0b, with underscores); null for others and what BIGINT does
    not hold."""
    t = F.lower(F.regexp_replace(text, "_", ""))
    out = F.expr("CAST(NULL AS BIGINT)")
    for prefix, base, digits, most in (("0x", 16, "0-9a-f", 16), ("0o", 8, "0-7", 21), ("0b", 2, "01", 63)):  # more digits do not fit
        value = F.regexp_replace(t, f"^{prefix}0*(?=.)", "")
        out = F.when(t.rlike(f"^{prefix}0*[{digits}]{{1,{most}}}$"), F.conv(value, base, 10).try_cast("bigint")).otherwise(out)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).otherwise(out)


def code_context(path: Column, lineno: Column, code: Column) -> Column:
    first = F.substring_index(code, "\n", 1)
    return F.format_string("%s:%d: %s", path, lineno, F.concat(first, F.when(F.instr(code, "\n") > 0, F.lit(" [Trimmed]")).otherwise(F.lit(""))))

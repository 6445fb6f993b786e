"""Column expressions on identities: storage keys, owners, arities, locations, control paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import BRANCHES, LOOPS


def storage_key(module: Column, scope: Column, symbol: Column) -> Column:
    """module::scope::symbol with % and : of the module escaped."""
    safe = F.replace(F.replace(module, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    return F.concat_ws("::", safe, scope, symbol)


def symbol_of(key: Column) -> Column:
    """What follows the second double colon; a text that is no key comes back as it is."""
    return F.when(is_key(key), F.regexp_extract(key, r"^[^:]*::[A-Z]+::(.*)$", 1)).otherwise(key)


def is_key(key: Column) -> Column:
    return key.rlike(r"^[^:]*::(MAIN|TEST|GENERATED)::")


def owner_of(key: Column) -> Column:
    """The type of a member: up to the first #."""
    return F.substring_index(key, "#", 1)


def enclosing_method(key: Column) -> Column:
    """The method around a synthetic body: up to the first $anon@ or $lambda@."""
    return F.substring_index(F.substring_index(key, "$anon@", 1), "$lambda@", 1)


def arity_key(symbol: Column) -> Column:
    """Type#name/arity of Type#name(a,b)."""
    inside = F.regexp_extract(symbol, r"\((.*)\)$", 1)
    arity = F.when(F.trim(inside) == "", F.lit(0)).otherwise(F.size(F.split(inside, ",")))
    return F.concat(F.substring_index(symbol, "(", 1), F.lit("/"), arity.cast("string"))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def line_of(location: Column) -> Column:
    return F.nullif(F.regexp_extract(location, r"L([0-9]+)", 1), F.lit("")).cast("int")


def path_kinds(context: Column) -> Column:
    """Kinds of a control path kind@Lline>kind@Lline."""
    return F.transform(F.split(context, ">"), lambda s: F.substring_index(s, "@", 1))


def in_loop(context: Column) -> Column:
    return F.coalesce(F.exists(path_kinds(context), lambda k: k.isin(*LOOPS)), F.lit(False))


def in_branch(context: Column) -> Column:
    return F.coalesce(F.exists(path_kinds(context), lambda k: k.isin(*BRANCHES)), F.lit(False))


def innermost_branch(context: Column) -> Column:
    """The last segment of the path that is a branch, null without one."""
    own = F.filter(F.split(context, ">"), lambda s: F.substring_index(s, "@", 1).isin(*BRANCHES))
    return F.try_element_at(own, F.lit(-1))


def glob_like(pattern: str) -> str:
    """* and ? as the wildcards of LIKE; % and _ keep their meaning there."""
    return pattern.replace("*", "%").replace("?", "_")


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression in which only * and ? are special; runs of * count as one."""
    import re

    return "^" + "".join(".*" if p.startswith("*") else "." if p == "?" else re.escape(p) for p in re.findall(r"\*+|\?|[^*?]+", pattern)) + "$"


def doc_summary(text: Column) -> Column:
    """First sentence: up to a full stop before white space, end or <, or an ideographic stop; never
    beyond a tag."""
    body = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)(?=(\n\s*@\w)|$)", 1), r"\s+", " "))
    sentence = F.regexp_extract(body, r"^(.*?(?:\.(?=\s|$|<)|\x{3002}))", 1)
    return F.when(text.isNull(), None).when(sentence == "", body).otherwise(sentence)


def doc_body(text: Column) -> Column:
    """Text before the first blank line or tag."""
    return F.trim(F.regexp_extract(text, r"(?s)^(.*?)(?=\n\s*\n|\n\s*@\w|$)", 1))


def shell_quoted(text: Column) -> Column:
    """A word as a shell takes it whole: as it is if its signs are harmless, else in single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(text.rlike(r"^[A-Za-z0-9_./:@%+=,-]+$"), text).otherwise(quoted)


def json_with(text: Column, key: str, value: Column) -> Column:
    """A JSON object of texts with one key set; the others keep their order, the key's place if it had
    one is given up for the last. No object at all counts as an empty one."""
    old = F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    rest = F.map_filter(old, lambda k, v: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))

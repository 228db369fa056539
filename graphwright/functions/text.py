"""Column functions over paths, ids, identifiers and query text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
SPACE = " \t\n\x0b\f\r"
PATH_PRIORITY = {"resource": 20}

#: Prior of a node kind in search.
KIND_PRIORITY = {"script_class": 40, "scene": 40, "autoload": 35, "scene_node": 35, "method": 30, "signal": 30, "property": 25, "resource": 20}
#: Order of relationship kinds in a context; other kinds 50.
RELATION_PRIORITY = {"attaches_script": 10, "instantiates_scene": 15, "main_scene": 15, "calls": 20, "emits_signal": 20, "connects_signal": 20, "uses_autoload": 25, "uses_input_action": 25, "references_symbol": 25, "references_nodepath": 25, "loads_resource": 30, "preloads_resource": 30, "extends": 35, "contains": 70}
#: Score of a field that equals, starts with or contains a term, exactly or but for case.
TIERS = (("equal", 1000, 850), ("prefix", 300, 240), ("inside", 120, 90))


def case(column: Column, table: dict[str, int], otherwise: int) -> Column:
    return reduce(lambda acc, kv: acc.when(column == kv[0], kv[1]), table.items(), F.when(F.lit(False), F.lit(0))).otherwise(otherwise)


def kind_priority(kind: Column) -> Column:
    return case(kind, KIND_PRIORITY, 0)


def relation_priority(kind: Column) -> Column:
    return case(kind, RELATION_PRIORITY, 50)


def field_score(field: Column, term: Column, lowered: Column | None = None) -> Column:
    """Best tier of one field against one term; 0 if it is not there or null."""
    low, q = F.lower(field) if lowered is None else lowered, F.lower(term)
    score = (
        F.when(field == term, 1000).when(low == q, 850).when(F.startswith(field, term), 300).when(F.startswith(low, q), 240)
        .when(F.instr(field, term) > 0, 120).when(F.instr(low, q) > 0, 90).otherwise(0)
    )
    return F.coalesce(score, F.lit(0))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def ranking_terms(query: Column, most: int = 48) -> Column:
    """Ordered distinct: the query, its paths, their basenames, marked identifiers, all tokens."""
    paths = F.regexp_extract_all(query, F.lit(r"res://[^\s'\"`,)]+"), F.lit(0))
    words = tokens(query)
    marked = F.filter(words, lambda w: F.contains(w, F.lit("_")) | F.rlike(w, F.lit("[a-z][A-Z]")) | F.rlike(w, F.lit("^[A-Z]")))
    whole = F.array(F.btrim(query, F.lit(SPACE)))
    return F.slice(F.filter(F.array_distinct(F.concat(whole, paths, F.transform(paths, basename), marked, words)), lambda t: t != ""), 1, most)


#: The patterns that decide how a query is answered, tried in this order.
STRATEGIES = (
    ("relationship", r"(?i)\b(dependents?|dependencies|references?|refs?|callers?|callees?|impact)\b"),
    ("source-oriented", r"(?i)\bres://[^\s\"',)]+\.gd\b|\b(offset|source|snippet|window)\b"),
    ("resource-first", r"(?i)\bres://[^\s\"',)]+\.(?:tres|res|tscn)\b|\.(?:tres|res|tscn)\b|\bresources?\b|\b(display_name|display_label|payload|weights?|metadata)\b"),
    ("symbol-first", r"[A-Z][A-Za-z0-9_]*|[A-Z0-9_]{3,}|[a-z]+_[a-z0-9_]+"),
)
#: Words that name fields of resources, and what an edit is called.
FIELD_WORDS = ("display_name", "display_label", "description", "payload_id", "base_weight", "weight_keys", "group_keys", "metadata", "resources")
EDIT = r"(?i)\b(edit|change|modify|impact|refactor|delete|rename|fix)\b"
PATH_ANCHOR = r"(?i)\bres://[^\s\"',)]+\.(?:tres|res|tscn)\b"
FRAGMENT = r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+"


def strategy(query: Column) -> Column:
    """How a free-text query is to be answered; the first rule that matches."""
    out = F.lit("general")
    for name, pattern in reversed(STRATEGIES):
        out = F.when(F.rlike(query, F.lit(pattern)), name).otherwise(out)
    return out


def _found(query: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)))


def _fragment(path: Column) -> Column:
    """Lower case, without scheme and outer slashes."""
    bare = F.regexp_replace(F.lower(path), "^res://", "")
    return F.regexp_replace(F.regexp_replace(bare, "^/+", ""), "/+$", "")


def plan(query: Column) -> Column:
    """Everything a context is planned from, as one struct: strategy, anchors, terms by use."""
    words = _found(query, r"[A-Za-z_][A-Za-z0-9_]*")
    paths = _found(query, PATH_ANCHOR)
    up = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise("")
    fragments = F.transform(F.transform(F.regexp_extract_all(query, F.lit(FRAGMENT), F.lit(0)), _fragment), lambda p: F.when(F.rlike(p, F.lit(r"\.(?:tres|res|tscn)$")), up(p)).otherwise(p))
    directories = F.array_distinct(F.filter(F.concat(F.transform(paths, lambda p: up(_fragment(p))), fragments), lambda p: p != ""))
    capital = lambda w: F.rlike(w, F.lit("^[A-Z]"))
    underscores = lambda w: F.char_length(w) - F.char_length(F.replace(w, F.lit("_"), F.lit("")))
    named = F.filter(words, lambda w: ~capital(w) & ~w.isin(*FIELD_WORDS) & ((underscores(w) >= 2) | (underscores(w) == 1) & F.rlike(w, F.lit("[0-9]"))))
    opaque = F.filter(words, lambda w: F.array_contains(named, w) | F.rlike(w, F.lit("^[A-Z0-9_]{4,}$")))
    kind = strategy(query)
    return F.struct(
        query.alias("query"), kind.alias("strategy"), F.array_distinct(F.concat(paths, words)).alias("exact"), paths.alias("paths"), directories.alias("directories"), named.alias("resource_names"), opaque.alias("opaque"),
        ((F.size(opaque) == 0) | (kind == "resource-first") & (F.size(directories) > 0)).alias("fallback"), F.filter(words, capital).alias("symbols"),
        F.filter(words, lambda w: F.contains(w, F.lit("_")) | w.isin(*FIELD_WORDS)).alias("fields"), text_terms(query).alias("texts"),
    )


def stem(word: Column) -> Column:
    n = F.char_length(word)
    return F.when((n > 4) & F.endswith(word, F.lit("ies")), F.concat(F.left(word, n - 3), F.lit("y"))).when((n > 4) & F.endswith(word, F.lit("s")), F.left(word, n - 1)).otherwise(word)


def text_terms(query: Column) -> Column:
    """Lower-case stems of at least three letters; camel humps and other marks split words."""
    split = F.regexp_replace(F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    words = F.filter(F.transform(F.split(split, " "), F.lower), lambda w: F.char_length(w) >= 3)
    return F.array_distinct(F.transform(words, stem))

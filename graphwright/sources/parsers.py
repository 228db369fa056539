"""Parsers of project text: manifest, scenes and resources, scripts. Each turns one file into fact
rows; Spark runs them file by file. All later steps are relational.

A fact is (path, ord, fact, line, owner, method, name, receiver, target, attrs).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, ord int, fact string, line int, owner string, method string, name string, receiver string, target string, attrs map<string,string>"
COLUMNS = ["path", "ord", "fact", "line", "owner", "method", "name", "receiver", "target", "attrs"]
#: Words and engine functions before a parenthesis that are no references. Annotations
#: (after @), assertion helpers and constructors of built-in types follow from rules instead.
NO_CALLS = frozenset(
    """
    abs absf accept_event add_child add_theme_color_override add_theme_font_size_override add_theme_stylebox_override and append append_array back begins_with bind bool
    call call_deferred can_instantiate ceil clear clampf clampi connect contains cos create_tween current_is_dir dir_exists_absolute disconnect distance_to duplicate
    emit emit_signal erase ends_with exists fail file_exists filter float floor force_drag free front get get_as_text get_base_dir get_center get_class
    get_combined_minimum_size get_children get_cmdline_user_args get_file_as_string get_global_rect get_main_loop get_method_list get_next get_parent get_property_list
    get_script get_script_method_list get_setting get_theme_constant get_theme_font_size get_theme_stylebox get_ticks_usec get_tree get_node get_node_or_null get_viewport
    get_viewport_rect globalize_path grab_focus gui_get_drag_data has has_method has_signal has_theme_font_size_override hex_encode if in insert int instantiate
    is_action_just_pressed is_action_just_released is_action_pressed is_action_released is_connected is_inside_tree is_empty is_instance_valid is_equal_approx is_valid_int
    is_valid is_visible_in_tree is_zero_approx join keys length list_dir_begin list_dir_end lightened make_dir_recursive_absolute map max maxf maxi merge min minf mini new
    normalized not ok or parallel parse_string path_join pick_random posmod pow print printerr push_error push_warning queue_free queue_redraw quit randomize range reduce
    remove_at remove_child replace return roundf roundi randf randf_range randi randi_range resize seed set set_border_width_all set_corner_radius_all set_drag_preview
    set_ease set_input_as_handled set_process set_shader_parameter set_trans size sin sort sort_custom slice split str store_line store_string stringify strip_edges substr
    super typeof tween_property tween_interval lerpf draw_arc draw_circle draw_line draw_rect to_utf8_buffer trim_prefix values for while match func preload load
    """.split()
)
#: Calls that are no references with these receivers, or with any receiver.
NO_QUALIFIED_CALLS = frozenset(("DirAccess.open", "FileAccess.open"))
NO_MEMBER_CALLS = frozenset("dot find finish kill length_squared rotated update".split())
#: Signals of the engine, whose emits count only where the file declares them.
BUILTIN_SIGNALS = frozenset(("mouse_entered", "mouse_exited", "pressed"))


class _Facts(list):
    def add(self, fact: str, line: int | None, name: str | None = None, *, owner=None, method=None, receiver=None, target=None, **attrs) -> None:
        self.append((fact, line, owner, method, name, receiver, target, {k: str(v) for k, v in attrs.items() if v is not None}))


def unquote(value: str) -> str:
    value = value.strip()
    return value[1:-1].replace('\\"', '"') if len(value) > 1 and value[0] == value[-1] == '"' else value


def brackets(text: str, pairs: str = "{}[]()") -> int:
    """Opening minus closing brackets outside double-quoted strings."""
    bare = re.sub(r'"(?:\\.|[^"\\])*"?', "", text)
    return sum(bare.count(c) for c in pairs[::2]) - sum(bare.count(c) for c in pairs[1::2])


def parse_manifest(text: str) -> _Facts:
    facts, section, depth = _Facts(), None, 0
    for at, raw in enumerate(re.split(r"\r?\n", text), 1):
        line = raw.strip()
        if depth > 0:
            depth = max(0, depth + line.count("{") - line.count("}"))
            continue
        if not line or line.startswith(";"):
            continue
        if head := re.fullmatch(r"\[([^\]]+)\]", line):
            section = head[1]
            continue
        key, equals, value = line.partition("=")
        if not equals:
            facts.add("error", at, "Expected key=value assignment")
            continue
        key, value = key.strip(), value.strip()
        if section == "application" and key in ("config/name", "run/main_scene"):
            facts.add("project_name" if key == "config/name" else "main_scene", at, unquote(value))
        elif section == "autoload":
            path = unquote(value)
            facts.add("autoload", at, key, target=path.removeprefix("*"), singleton=path.startswith("*"))
        elif section == "input":
            facts.add("input_action", at, key)
        depth = max(0, value.count("{") - value.count("}"))
    return facts


ATTRIBUTE = re.compile(r'([\w/]+)=("(?:\\.|[^"\\])*"|\w+\("[^"]*"\)|\S+)')
REFERENCE = re.compile(r'^(ExtResource|SubResource)\("([^"]+)"\)$')


def logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines with the continuation of open brackets joined, trimmed, by line feeds."""
    held, first, depth = [], 0, 0
    for at, raw in enumerate(re.split(r"\r?\n", text), 1):
        line = raw.strip()
        if not held and (not line or line.startswith(";")):
            continue
        first = first if held else at
        held.append(line)
        depth = max(0, depth + brackets(line)) if not (len(held) == 1 and line.startswith("[")) else 0
        if depth == 0:
            yield first, "\n".join(held)
            held = []
    if held:
        yield first, "\n".join(held)


def value_type(value: str) -> str:
    """reference, boolean, string, number or raw."""
    if REFERENCE.match(value):
        return "reference"
    if value in ("true", "false"):
        return "boolean"
    if len(value) > 1 and value[0] == value[-1] == '"':
        return "string"
    try:
        return "number" if value and math.isfinite(float(value)) and "_" not in value else "raw"
    except ValueError:
        return "number" if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", value) else "raw"


NEEDED = {"ext_resource": ("id", "path"), "sub_resource": ("id",), "node": ("name",), "connection": ("signal", "from", "to", "method")}


def parse_resource(text: str) -> _Facts:
    facts, kind, name, seen = _Facts(), None, None, False
    for at, line in logical_lines(text):
        if line.startswith("[") and line.endswith("]"):
            kind, *_ = line[1:-1].split(" ", 1)
            attrs = {k: unquote(v) for k, v in ATTRIBUTE.findall(line)}
            if kind in ("gd_scene", "gd_resource"):
                seen = True
                facts.add("header", at, "scene" if kind == "gd_scene" else "resource", **{k: v for k, v in attrs.items() if k != "path"})
            elif kind in NEEDED:
                if missing := [k for k in NEEDED[kind] if k not in attrs]:
                    facts.add("error", at, f"{kind} without {', '.join(missing)}")
                    kind = None
                    continue
                name = attrs.get("id") if kind.endswith("resource") else attrs.get("name")
                facts.add(kind, at, name or attrs.get("signal"), target=attrs.get("path") or attrs.get("method"), **{k if k not in ("method", "name", "path") else f"a_{k}": v for k, v in attrs.items()})
            elif kind == "resource":
                name = "resource"
            else:
                kind = None
        elif kind in ("node", "sub_resource", "resource") and "=" in line:
            key, _, value = line.partition("=")
            ref = REFERENCE.match(value.strip())
            facts.add("assign", at, key.strip(), owner=name, method=kind, receiver=ref[1] if ref else None, target=ref[2] if ref else unquote(value), type=value_type(value.strip()))
    if not seen:
        facts.add("error", None, "no scene or resource header")
    return facts


def strip_comment(line: str) -> str:
    found = re.match(r'(?:[^"#]|"(?:\\.|[^"\\])*"?)*', line)
    return found[0] if found else line


def mask(line: str) -> str:
    """Strings blanked at equal length."""
    return re.sub(r'"(?:\\.|[^"\\])*"?', lambda m: '"' + " " * max(0, len(m[0]) - 2) + ('"' if len(m[0]) > 1 else ""), line)


def arguments(text: str) -> list[str]:
    """Top-level comma parts of a call's inside, as far as it is closed or complete."""
    out, depth, start, hidden = [], 0, 0, mask(text)
    for at, c in enumerate(hidden):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                out.append(text[start:at].strip())
                return out
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:at].strip())
            start = at + 1
    return out


def callable_name(target: str, aliases: dict[str, str]) -> str:
    """Method a callable expression names."""
    target = re.sub(r"\.bind\(.*$", "", target.strip())
    target = aliases.get(target, target)
    if found := re.match(r'Callable\(\s*[^,]+,\s*"([^"]+)"', target):
        return found[1]
    return target.strip('"').removeprefix("self.")


FUNC = re.compile(r"^(static\s+)?func\s+(\w+)")
VARIABLE = re.compile(r"^(@export\s+)?(var|const)\s+(\w+)(?:\s*:\s*([\w.\[\], ]+?))?\s*(?::?=|$)")


def parse_script(text: str, no_calls: frozenset[str] = NO_CALLS) -> _Facts:
    """Line scanner with a stack of class scopes and one function scope; indentation is counted in
    characters. References belong to the enclosing method, else to the script."""
    facts, classes, func, func_indent, open_head, head = _Facts(), [], None, -1, False, None
    aliases: dict[str, str] = {}
    for at, raw in enumerate(re.split(r"\r?\n", text), 1):
        line = strip_comment(raw).rstrip()
        if not line.strip():
            continue
        if open_head:
            open_head = not line.endswith(":")
            head[7]["signature"] += " " + line.strip()
            if not open_head:
                _signature(facts, head)
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if func and indent <= func_indent:
            func = None
        while classes and indent <= classes[-1][1]:
            classes.pop()
        owner = classes[-1][0] if classes else None
        if not func:
            if found := re.match(r"^class\s+(\w+).*:", body):
                facts.add("inner_class", at, found[1], owner=owner)
                classes.append((found[1], indent))
                continue
            if found := FUNC.match(body):
                func, func_indent, open_head = found[2], indent, not body.endswith(":")
                facts.add("method", at, func, owner=owner, static=bool(found[1]), signature=body)
                head = facts[-1]
                if not open_head:
                    _signature(facts, head)
                continue
            if found := re.match(r"^signal\s+(\w+)", body):
                facts.add("signal", at, found[1], owner=owner)
                continue
            if found := re.match(r'^extends\s+"?([^"]+?)"?$', body):
                facts.add("extends", at, found[1])
                continue
            if found := re.match(r"^class_name\s+(\w+)", body):
                facts.add("class_name", at, found[1])
                continue
            if found := VARIABLE.match(body):
                facts.add("property", at, found[3], owner=owner, target=found[4], exported=bool(found[1]), kind=found[2], signature=body)
        scope = {"owner": owner, "method": func}
        if func:
            _local(facts, at, body, scope)
        if found := re.match(r"""^const\s+(\w+)\s*:?=\s*preload\(\s*["']([^"']+\.gd)["']\s*\)""", body):
            facts.add("script_alias", at, found[1], target=found[2])
        hidden = mask(body)
        for kind, path in re.findall(r'\b(preload|load)\("([^"]+)"\)', body):
            facts.add("resource", at, path, receiver=kind, **scope)
        for action in re.findall(r'\bInput\.is_action_\w+\("([^"]+)"\)', body):
            facts.add("action", at, action, **scope)
        rooted = set()
        for path in re.findall(r'(?:^|[^.\w])get_node(?:_or_null)?\("(/root/[^"]+)"\)|\.root\.get_node(?:_or_null)?\("([^"]+)"\)', body):
            path = path[0] or path[1]
            rooted.add(path)
            facts.add("node_path", at, path, target="root", **scope)
            facts.add("autoload_use", at, path.removeprefix("/root/").split("/")[0])
        for receiver, path in re.findall(r'(?:\b([A-Za-z_][\w.]*)\.)?get_node(?:_or_null)?\("([^"]+)"\)', body):
            if path not in rooted:
                facts.add("node_path", at, path, receiver=receiver or None, **scope)
        for path in re.findall(r"(?<![\w)])\$([\w/]+)", hidden):
            facts.add("node_path", at, path, **scope)
        for path in re.findall(r"(?<![\w)\s])%(\w+)|(?:^|[=(,\s])%(\w+)", hidden):
            facts.add("node_path", at, "%" + (path[0] or path[1]), **scope)
        if found := re.match(r"var\s+(\w+)\s*:?=\s*(Callable\(.*)", body):
            aliases[found[1]] = found[2]
        for name in re.findall(r'\bemit_signal\("(\w+)"', body):
            facts.add("emit", at, name, **scope)
        for found in re.finditer(r"(?<![\w.])(\w+)\.emit\(", hidden):
            facts.add("emit", at, found[1], **scope)
        for found in re.finditer(r"(?:([\w.]+)\.)?(\w+)\.connect\(", hidden):
            if args := arguments(body[found.end() :]):
                facts.add("connect", at, found[2], receiver=found[1], target=callable_name(args[0], aliases), **scope)
        for found in re.finditer(r'(?<![\w.])connect\(', hidden):
            args = arguments(body[found.end() :])
            if len(args) > 1:
                facts.add("connect", at, args[0].strip('"'), target=callable_name(args[1], aliases), **scope)
        for found in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", hidden):
            name, before = found[1], hidden[: found.start()]
            receiver = re.search(r"([\w.]+)\.$", before)
            member = receiver[1] if receiver else None
            if before.endswith(".") and not member or before.endswith("@") or name.startswith("assert_") or member is None and name[0].isupper():
                continue
            if name not in no_calls and f"{member}.{name}" not in NO_QUALIFIED_CALLS and not (member and name in NO_MEMBER_CALLS):
                facts.add("call", at, name, receiver=member, **scope)
        for name in sorted(set(re.findall(r"(?<![$%\w.])([A-Z]\w*)\.", hidden)) - {"Input"}):
            facts.add("autoload_use", at, name, **scope)
        uses = hidden.partition("=")[2] if re.match(r"^(@\w+\s+)*(var|const)\b", hidden) else hidden
        for receiver, name in sorted(set(re.findall(r"\b([A-Za-z_][\w.]*)\.(\w+)\b(?!\s*\()", uses))):
            facts.add("symbol", at, name, receiver=receiver, **scope)
        dotted = re.sub(r"[A-Za-z_]\w*(?:\.\w+)+", lambda m: " " * len(m[0]), uses)
        for name in sorted(set(re.findall(r"\b([A-Z]\w*)\b(?!\s*\()", dotted))):
            facts.add("symbol", at, name, **scope)
    own = {f[4] for f in facts if f[0] == "signal"}
    return _Facts(f for f in facts if f[0] != "emit" or f[4] in own or f[4] not in BUILTIN_SIGNALS)


def _signature(facts: _Facts, head: tuple) -> None:
    """Return and parameter types of a method whose whole head has been read."""
    _, line, owner, _, method, _, _, attrs = head
    if returns := re.search(r"->\s*([\w.]+)", attrs["signature"]):
        attrs["returns"] = returns[1]
    for name, kind in re.findall(r"[(,]\s*(\w+)\s*:\s*([A-Za-z_]\w*)", attrs["signature"]):
        facts.add("parameter", line, name, owner=owner, method=method, target=kind)


#: What the right side of a local declaration tells about its type, first match wins.
FORMS = (("new", re.compile(r"([A-Za-z_]\w*)\.new\s*\(")), ("cast", re.compile(r".+\s+as\s+([A-Za-z_]\w*)\b")), ("return", re.compile(r"([A-Za-z_]\w*)\s*\(")), ("alias", re.compile(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\b")))


def _local(facts: _Facts, at: int, body: str, scope: dict) -> None:
    """A local's name, and under receiver and target the form and text that its type follows from."""
    if found := re.match(r"for\s+(\w+)\s+in\s+([^:]+):", body):
        facts.add("local", at, found[1], receiver="loop", target=found[2].strip(), **scope)
    elif found := re.match(r"var\s+(\w+)\s*(?::\s*([A-Za-z_][\w.\[\], ]*?))?\s*(?::?=\s*(.*))?$", body):
        if found[2] and found[2] != "Variant":
            facts.add("local", at, found[1], receiver="type", target=found[2], **scope)
        for form, pattern in FORMS if found[3] and not (found[2] and found[2] != "Variant") else ():
            if value := pattern.match(found[3]):
                facts.add("local", at, found[1], receiver=form, target=value[1], **scope)
                break


PARSERS = {"project": parse_manifest, "gdscript": parse_script, "scene": parse_resource, "resource": parse_resource}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
            rows += [(path, k, *fact) for k, fact in enumerate(PARSERS[kind](content or ""))]
        yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "Int32", "ord": "int32"})


def facts(files: DataFrame) -> DataFrame:
    """Fact rows of a file table (path, kind, content); one pass, files in parallel."""
    return files.select("path", "kind", "content").mapInPandas(_parse, FACTS)

"""Functions without a built-in equivalent, as Arrow-batched UDFs; keep them off the hot path."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of a compacted value.
MAX_DEPTH, MAX_KEYS, MAX_ITEMS, MAX_CHARS = 4, 30, 20, 500


@F.pandas_udf(T.StringType())
def decompose(text: pd.Series) -> pd.Series:
    """Canonical decomposition (NFD)."""
    return text.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def parsed(text: str):
    """Value of a text that looks like a JSON object or array; null if it is none."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(text)
        except ValueError:
            pass
    return None


class Compactor:
    """A bounded view of JSON values. With ``keep``, keys of objects that do not match it leave only what matches inside
    them; ``drop`` removes keys at every depth. Case does not count. Strings that hold JSON are read as such."""

    def __init__(self, keep: str | None = None, drop: tuple[str, ...] = ()):
        self.keep = re.compile(keep, re.IGNORECASE) if keep else None
        self.drop = {k.lower() for k in drop}

    def __call__(self, value):
        found = self._view(value, 0, wanted=True, inside=False)
        return found[0] if found else None

    def _view(self, value, depth: int, wanted: bool, inside: bool) -> list:
        """The view in a list of one, or nothing; ``wanted`` is false below keys that do not match."""
        if isinstance(value, str):
            inner = parsed(value)
            if inner is not None:
                return self._view(inner, depth + 1, wanted, inside)
            text = value.strip()
            return [text if len(text) <= MAX_CHARS else text[: MAX_CHARS - 3] + "..."] if wanted else []
        if depth > MAX_DEPTH:
            return ["<nested>"] if wanted else []
        if isinstance(value, dict):
            out = {}
            for key, item in value.items():
                if len(out) == MAX_KEYS:
                    break
                if key.lower() not in self.drop:
                    match = (inside and wanted) or self.keep is None or bool(self.keep.search(key))
                    out |= {key: v for v in self._view(item, depth + 1, match, True)}
            return [out] if out or wanted else []
        if isinstance(value, list):
            items = [v for x in value[:MAX_ITEMS] for v in self._view(x, depth + 1, wanted, inside)]
            return [items] if items or wanted else []
        return [value] if wanted else []


compact = Compactor()


def compact_result(keep: str | None, drop: tuple[str, ...] = ()):
    """A UDF that compacts JSON texts with these key rules."""
    view = Compactor(keep, drop)

    @F.pandas_udf(T.StringType())
    def compacted(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(view(t), sort_keys=True, separators=(",", ":")), na_action="ignore")

    return compacted


@F.pandas_udf(T.StringType())
def compact_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json.dumps(compact(t), sort_keys=True, separators=(",", ":")), na_action="ignore")


def compact_transcripts(keep: str | None = None, drop: tuple[str, ...] = ()):
    """A function for ``mapInArrow`` on rows with ``transcript`` and ``runtime``: arguments, errors and the runtime compacted,
    results with these key rules; nulls stay."""
    rules = {"arguments": compact, "error": compact, "result": Compactor(keep, drop)}

    def shown(value: str | None, view) -> str | None:
        return None if value is None else json.dumps(view(value), sort_keys=True, separators=(",", ":"))

    def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["runtime"] = shown(row["runtime"], compact)
                for entry in row["transcript"]:
                    entry.update({name: shown(entry[name], view) for name, view in rules.items()})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return compacted


def haystack(skip: tuple[str, ...] = ()):
    """A UDF: every scalar of a JSON text in lower case with single spaces, outside the fields in ``skip``, joined by NUL."""

    def collect(value) -> list[str]:
        if isinstance(value, dict):
            return [x for k, v in value.items() if k not in skip for x in collect(v)]
        if isinstance(value, list):
            return [x for v in value for x in collect(v)]
        plain = isinstance(value, (str, int, float)) and not isinstance(value, bool)
        return [re.sub(r"\s+", " ", str(value)).casefold()] if plain else []

    @F.pandas_udf(T.StringType())
    def joined(text: pd.Series) -> pd.Series:
        return text.map(lambda t: "\x00".join(collect(json.loads(t))), na_action="ignore")

    return joined


def with_parameters(config: str, changes: str):
    """A configuration (JSON text) with values set at dotted paths (a JSON object of them), parents made as needed."""

    @F.pandas_udf(T.StringType())
    def updated(texts: pd.Series, updates: pd.Series) -> pd.Series:
        out = []
        for text, update in zip(texts, updates, strict=True):
            whole = json.loads(text)
            for path, value in json.loads(update).items():
                *parents, leaf = path.split(".")
                node = whole
                for key in parents:
                    node = node.setdefault(key, {})
                node[leaf] = value
            out.append(json.dumps(whole, sort_keys=True, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return updated(config, changes)


def nested(value) -> set[str]:
    if isinstance(value, dict):
        return set(value).union(*map(nested, value.values()))
    return set().union(*map(nested, value)) if isinstance(value, list) else set()


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_keys(text: pd.Series) -> pd.Series:
    """Sorted keys at every depth of a JSON text; null if it does not parse."""

    def keys(t):
        try:
            return sorted(nested(json.loads(t)))
        except ValueError:
            return None

    return text.map(keys, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_leaves(text: pd.Series) -> pd.Series:
    """All strings in a JSON text, in order."""

    def leaves(v):
        if isinstance(v, str):
            return [v]
        parts = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return [x for p in parts for x in leaves(p)]

    return text.map(lambda t: leaves(json.loads(t)), na_action="ignore")


_PLACEHOLDER = re.compile(r"\$\{([^}]*)\}")


def fill(template: str, values: dict[str, str], bound: int = 10_000) -> tuple[str, list[str]]:
    """Replace placeholders from the left, reading replaced text again, at most ``bound`` times; a missing or
    empty value leaves nothing behind and is reported."""
    missing = []
    for _ in range(bound):
        found = _PLACEHOLDER.search(template)
        if not found:
            break
        value = values.get(found[1], "")
        if not value:
            missing.append(found[1])
        template = template[: found.start()] + value + template[found.end() :]
    return template, missing


_FILLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FILLED)
def fill_placeholders(template: pd.Series, context_json: pd.Series) -> pd.DataFrame:
    rows = [fill(t or "", json.loads(c or "{}")) for t, c in zip(template, context_json, strict=True)]
    return pd.DataFrame(rows, columns=["text", "missing"])


_SECTION = re.compile(r"^[ \t]*Assistant:", re.MULTILINE)


def render(template: str, values: dict[str, str]) -> tuple[str, str | None, str, list[str]]:
    """(prompt, system, user, missing): the part before the assistant's section, filled, as one text and as messages.

    Without both a System and a User section the whole text is the user's message.
    """
    cut = _SECTION.search(template)
    body, rest = (template[: cut.start()], template[cut.start() :]) if cut else (template, "")
    text, missing = fill(body, values)
    missing = sorted({*missing, *fill(rest, values)[1]})
    text = text.rstrip()
    _, has_system, after = text.partition("System:")
    system = after.partition("User:")[0]
    if has_system and "User:" in text:
        user = text.partition("User:")[2].strip()
        system = system.strip()
        return f"{system}\n\n{user}", system, user, missing
    return text, None, text, missing


_PROMPT = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("system", T.StringType()), T.StructField("user", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(_PROMPT)
def render_prompt(template: pd.Series, context_json: pd.Series) -> pd.DataFrame:
    rows = [render(t or "", json.loads(c or "{}")) for t, c in zip(template, context_json, strict=True)]
    return pd.DataFrame(rows, columns=["prompt", "system", "user", "missing"])

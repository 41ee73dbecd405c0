"""Structured data of a page: JSON-LD checks, microdata as JSON-LD, summaries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .htmltree import Element

#: What checks say.
BAD_ROOT = "JSON-LD root must be an Object or Array of Objects."
BAD_ITEM = "Schema block in array is not an object."
NO_CONTEXT = "Missing '@context' property."
OTHER_CONTEXT = "Non-standard @context: '{}'. Expected schema.org."
NO_TYPE = "Missing '@type' property."
NO_JSON = "JSON parsing error: {}"


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def load(text: str):
    """JSON in the strict sense: no NaN or Infinity."""
    return json.loads(text, parse_constant=_refuse)


def check(block: str) -> list[str]:
    """What is wrong with a JSON-LD block."""
    try:
        value = load(block)
    except (ValueError, RecursionError) as wrong:
        return [NO_JSON.format(wrong)]
    if not isinstance(value, dict | list):
        return [BAD_ROOT]
    errors = []
    for item in value if isinstance(value, list) else [value]:
        if not isinstance(item, dict):
            errors.append(BAD_ITEM)
            continue
        context = item.get("@context")
        if not isinstance(context, str):
            errors.append(NO_CONTEXT)
        elif "schema.org" not in context:
            errors.append(OTHER_CONTEXT.format(context))
        if not {"@type", "@graph"} & item.keys():
            errors.append(NO_TYPE)
    return errors


#: The attribute that holds an element's microdata value.
VALUE_OF = {
    "meta": "content", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src",
    "a": "href", "area": "href", "link": "href", "object": "data", "data": "value", "meter": "value", "time": "datetime",
}


def _strip_all(text: str, prefix: str) -> str:
    while text.startswith(prefix):
        text = text[len(prefix) :]
    return text


#: Items nested deeper are given by their text: indented JSON grows with the square of its depth.
DEEPEST = 100


def _item(element: Element, depth: int = 0) -> dict:
    kind = "Thing"
    if "itemtype" in element.attrs:
        kind = element.attrs["itemtype"]
        for prefix in ("https://", "http://", "schema.org/"):
            kind = _strip_all(kind, prefix)
    found: dict[str, list] = {"@context": ["https://schema.org"], "@type": [kind]}
    pending = [c for c in reversed(element.children) if isinstance(c, Element)]
    while pending:
        child = pending.pop()
        scoped = "itemscope" in child.attrs
        if "itemprop" in child.attrs:
            attribute = VALUE_OF.get(child.tag)
            plain = child.attrs.get(attribute, "") if attribute else " ".join(child.strings()).strip()
            found.setdefault(child.attrs["itemprop"], []).append(_item(child, depth + 1) if scoped and depth < DEEPEST else plain)
        if not scoped:
            pending.extend(c for c in reversed(child.children) if isinstance(c, Element))
    return {k: v[0] if len(v) == 1 else v for k, v in found.items()}


def microdata(root: Element) -> list[str]:
    """Outermost items of a page, as JSON-LD."""
    out, pending = [], [root]
    while pending:
        element = pending.pop()
        if "itemscope" in element.attrs:
            out.append(json.dumps(_item(element), indent=2, ensure_ascii=False, sort_keys=True))
        else:
            pending.extend(c for c in reversed(element.children) if isinstance(c, Element))
    return out


def pretty(block: str) -> str:
    """A block with indents, as it is if it is no JSON."""
    try:
        return json.dumps(load(block), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return block


_TOKEN = re.compile(r'(?P<text>"(?:\\.|[^"\\])*")(?P<colon>\s*:)?|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>\b(?:true|false|null)\b)')


def tokens(block: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the keys, strings, numbers and words of a JSON text, for showing it."""
    found = []
    for m in _TOKEN.finditer(block):
        kind = "number" if m["number"] else "word" if m["word"] else "key" if m["colon"] else "string"
        found.append((m.start(), m.end("text") if m["text"] else m.end(), kind))
    return found


def combined(blocks: Column) -> Column:
    """All valid blocks as one JSON text: one as itself, several as an array; null if there is none."""
    valid = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    joined = F.array_join(valid, ",")
    return F.when(F.size(valid) > 1, F.concat(F.lit("["), joined, F.lit("]"))).when(F.size(valid) == 1, joined)


def _text_member(item: Column, key: str) -> Column:
    """A member if it is a string."""
    kind = F.schema_of_variant(F.try_variant_get(item, f'$["{key}"]', "variant"))
    return F.when(kind == "STRING", F.try_variant_get(item, f'$["{key}"]', "string"))


def _listed(items: Column, key: str) -> Column:
    return F.array_join(F.filter(F.transform(items, lambda i: _text_member(i, key)), lambda t: t.isNotNull()), ", ")


def summary(block: Column) -> Column:
    """(types, contexts) of a block: of an array's items joined by +, of an array in it by a comma."""
    value = F.try_parse_json(block)
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<variant>")

    def part(key: str, missing: str):
        def of(item: Column) -> Column:
            inner = F.try_variant_get(item, "$", "array<variant>")
            return F.when(F.schema_of_variant(item).startswith("ARRAY"), _listed(inner, key)).otherwise(F.coalesce(_text_member(item, key), F.lit(missing)))

        return of

    types, contexts = part("@type", "Unknown"), part("@context", "schema.org")
    unknown = F.struct(F.lit("Unknown (Invalid JSON)").alias("types"), F.lit("Unknown").alias("contexts"))
    several = F.struct(F.array_join(F.transform(items, types), " + ").alias("types"), F.array_join(F.transform(items, contexts), " + ").alias("contexts"))
    one = F.struct(types(value).alias("types"), contexts(value).alias("contexts"))
    return F.when(value.isNull(), unknown).when(kind.startswith("ARRAY"), F.when(F.size(items) > 0, several).otherwise(unknown)).when(kind.startswith("OBJECT"), one).otherwise(unknown)

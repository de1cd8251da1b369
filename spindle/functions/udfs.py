"""What built-in expressions can't say: sequence similarity and JSON in free text. Arrow batches, never single rows."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T


def ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; not symmetric, so that the order of arguments counts."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@lru_cache(maxsize=100_000)
def _counted(name: str) -> tuple[Counter, Counter, float]:
    """Characters and bigrams of a name, and the norm of the latter."""
    pairs = Counter(name[i : i + 2] for i in range(max(1, len(name) - 1))) if name else Counter()
    return Counter(name), pairs, sum(n * n for n in pairs.values()) ** 0.5


def alike(a: str, b: str, least: float) -> float:
    """1 for equal names, else the greater of matching blocks and bigram cosine; 0 where neither reaches least.

    Blocks can't match more than the characters that both have, which is counted first.
    """
    if a == b:
        return 1.0
    (x, p, m), (y, q, n) = _counted(a), _counted(b)
    cosine = sum(c * q[g] for g, c in p.items() if g in q) / (m * n) if m and n else 0.0
    most = 2 * sum(min(c, y[g]) for g, c in x.items() if g in y) / max(1, len(a) + len(b))
    s = max(cosine, ratio(a, b)) if most >= least else cosine
    return s if s >= least else 0.0


def alike_names(least: float):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, least) for x, y in zip(a, b)], dtype="float64")

    return run


def balanced_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, fences removed; None if there is none or it can't be read."""
    t = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip(), flags=re.IGNORECASE)
    begin = t.find("{")
    depth = 0
    for i in range(max(begin, 0), len(t) if begin >= 0 else 0):
        depth += (t[i] == "{") - (t[i] == "}")
        if not depth:
            try:
                return json.dumps(json.loads(t[begin : i + 1]), ensure_ascii=False)
            except ValueError:
                return None
    return None


def robust_object(text: str | None) -> str:
    """A JSON object by the first way that works: thoughts and fences removed, as it stands, mended, or by its fields."""
    t = re.sub(r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "", text or "").strip()
    tries = [*re.findall(r"(?is)```(?:json)?\s*(.*?)```", t), t]
    greedy = re.search(r"(?s)\{.*\}", t)
    tries += [greedy.group()] if greedy else []
    for x in tries:
        for mended in (x, re.sub(r",\s*([}\]])", r"\1", x), re.sub(r",\s*([}\]])", r"\1", x.replace("“", '"').replace("”", '"').replace("'", '"'))):
            found = balanced_object(mended)
            if found is not None:
                return found
    pick = lambda name, other: (m.group(1) if (m := re.search(rf'"{name}"\s*:\s*"([^"]*)', t)) else other)
    description = pick("detailed_description", "")
    entity = {"entity_name": pick("entity_name", "unknown_entity"), "entity_type": pick("entity_type", "unknown"), "summary": pick("summary", description[:100])}
    return json.dumps({"detailed_description": description, "entity_info": entity}, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(balanced_object)


@F.pandas_udf(T.StringType())
def robust_json(text: pd.Series) -> pd.Series:
    return text.map(robust_object)


def canonical_groups(text: str | None, allowed: set[str], least: float = 0.9) -> list[tuple[str, list[str], float]]:
    """Groups of an answer in JSON: canonical, members that were asked about, confidence; those without two members, or unsure, are left out."""
    t = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip(), flags=re.IGNORECASE)
    try:
        groups = json.loads(t).get("groups", [])
    except (ValueError, AttributeError):
        return []
    name = lambda x: " ".join(str(x).split())
    out = []
    for g in groups if isinstance(groups, list) else []:
        if not isinstance(g, dict) or not isinstance(g.get("members"), list):
            continue
        members = [m for m in map(name, g["members"]) if m in allowed]
        try:
            sure = float(g.get("confidence") or 0)
        except (TypeError, ValueError):
            sure = 0.0
        if len(members) > 1 and name(g.get("canonical", "")) in members and sure >= least:
            out.append((name(g["canonical"]), members, sure))
    return out


def told_field(value) -> str:
    """A value of any nesting as text: pairs joined by colons, items by wide semicolons; strings that hold JSON are read."""
    if value is None:
        return ""
    if isinstance(value, dict):
        items = ((k, told_field(v)) for k, v in value.items())
        return "；".join(f"{k}:{v}" for k, v in items if v)
    if isinstance(value, (list, tuple, set)):
        return "；".join(filter(None, map(told_field, value)))
    t = str(value).strip()
    if isinstance(value, str) and t[:1] in ("{", "["):
        try:
            return told_field(json.loads(t))
        except ValueError:
            return t
    return t


@F.pandas_udf(T.StringType())
def retrieval_field(text: pd.Series) -> pd.Series:
    return text.map(told_field)


def content_key(query: str, mode: str, content: str | None, options: str | None) -> str:
    """The key by which an answer to a query with content (a JSON list) is found again; paths count by name, large tables by hash."""
    items = []
    for item in json.loads(content) if content else []:
        if isinstance(item, dict):
            small = {}
            for k, v in item.items():
                if k in ("img_path", "image_path", "file_path") and isinstance(v, str):
                    small[k] = v.rstrip("/").rpartition("/")[2]
                elif k in ("table_data", "table_body") and isinstance(v, str) and len(v) > 200:
                    small[f"{k}_hash"] = hashlib.md5(v.encode()).hexdigest()
                else:
                    small[k] = v
            item = small
        items.append(item)
    known = ("stream", "response_type", "top_k", "enable_rerank", "max_tokens", "temperature")
    kept = {k: v for k, v in (json.loads(options) if options else {}).items() if k in known}
    told = json.dumps({"query": query.strip(), "mode": mode, "multimodal_content": items, **kept}, sort_keys=True, ensure_ascii=False)
    return "multimodal_query:" + hashlib.md5(told.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def query_cache_key(query: pd.Series, mode: pd.Series, content: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([None if q is None else content_key(q, m, c, o) for q, m, c, o in zip(query, mode, content, options)], dtype="object")


def parse_key(path: str, mtime: float, parser: str, method: str, options: str | None) -> str:
    known = ("lang", "device", "start_page", "end_page", "formula", "table", "backend", "source")
    kept = {k: v for k, v in (json.loads(options) if options else {}).items() if k in known}
    told = json.dumps({"file_path": path, "mtime": mtime, "parser": parser, "parse_method": method, **kept}, sort_keys=True)
    return hashlib.md5(told.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def parse_cache_key(path: pd.Series, mtime: pd.Series, parser: pd.Series, method: pd.Series, options: pd.Series) -> pd.Series:
    """The key of a parsed file: its path, time of change, parser, method and those options that change the result."""
    return pd.Series([None if p is None else parse_key(p, float(t), a, m, o) for p, t, a, m, o in zip(path, mtime, parser, method, options)], dtype="object")


@F.pandas_udf(T.BooleanType())
def blank_image(content: pd.Series) -> pd.Series:
    """Whether an image shows next to nothing; false where it can't be decoded, or where no decoder is installed."""
    try:
        import io

        from PIL import Image, ImageStat
    except ImportError:
        return pd.Series([False] * len(content))

    def one(raw: bytes | None) -> bool:
        try:
            with Image.open(io.BytesIO(raw or b"")) as im:
                small = im.convert("RGB")
                small.thumbnail((64, 64))
                return all(b - a <= 3 for a, b in small.getextrema()) or max(ImageStat.Stat(small).var) <= 3
        except Exception:  # noqa: BLE001
            return False

    return content.map(one)


def vision_parts(prompt: str, known: dict[str, str]) -> tuple[str, list[str]]:
    """A prompt whose image paths, where known holds their image, are followed by numbered markers; and the images in order."""
    images: list[str] = []

    def mark(m: re.Match) -> str:
        path = m.group(1).strip()
        if path not in known:
            return m.group(0)
        images.append(known[path])
        return f"{m.group(0)}\n[VLM_IMAGE_{len(images)}]"

    return re.sub(r"(?i)(?:Image\s*Path|图片路径)\s*[:：]\s*([^\n\r]*?\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))", mark, prompt), images


@F.pandas_udf(T.StructType([T.StructField("prompt", T.StringType()), T.StructField("images", T.ArrayType(T.StringType()))]))
def marked_prompt(prompt: pd.Series, paths: pd.Series, images: pd.Series) -> pd.DataFrame:
    """vision_parts of each prompt; paths and images are lists of equal length, images may be their keys."""
    out = [vision_parts(p or "", dict(zip(a if a is not None else (), b if b is not None else ()))) for p, a, b in zip(prompt, paths, images)]
    return pd.DataFrame({"prompt": [x for x, _ in out], "images": [y for _, y in out]})

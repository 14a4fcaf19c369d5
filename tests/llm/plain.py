"""Plain versions of the pipeline's stages, a document at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from netloom.llm import language_id, secret_links


def kneser_ney(grams: Counter) -> callable:
    """P(last letter | three before) from counts of four letters, by dictionaries."""
    levels = {}
    counts = {k: float(n) for k, n in grams.items()}
    for order in range(4, 0, -1):
        values = list(counts.values())
        once, twice = values.count(1.0), values.count(2.0)
        cut = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        total, kinds = Counter(), Counter()
        for k, n in counts.items():
            total[k[:-1]] += n
            kinds[k[:-1]] += 1
        levels[order] = (counts, cut, total, kinds)
        counts = {k: float(n) for k, n in Counter(k[1:] for k in counts).items()}

    known: dict[str, float] = {"": 1 / 65536}

    def p(key: str) -> float:
        if key not in known:
            counts, cut, total, kinds = levels[len(key)]
            context = key[:-1]
            if context not in total:
                known[key] = p(key[1:])
            else:
                known[key] = max(0.0, counts[key] - cut if key in counts else 0.0) / total[context] + cut * kinds[context] / total[context] * p(key[1:])
        return known[key]

    return p


def four_grams(text: str | None) -> list[str]:
    """Of the letters in lower case, one blank for whatever stands between them."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    padded = "  " + re.sub(" +", " ", f" {low} ")[1:]
    return [padded[i : i + 4] for i in range(len(padded) - 3)]


def languages(docs: list[dict]) -> dict[int, tuple[str, bool]]:
    """(language, rejected) by doc_id."""
    grams = {r["doc_id"]: four_grams(r["text"]) for r in docs}
    learn = [r for r in docs if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    counts: dict[str, Counter] = {}
    for r in learn:
        counts.setdefault(r["lang"], Counter()).update(grams[r["doc_id"]])
    models = {k: kneser_ney(c) for k, c in sorted(counts.items())}
    entropy = {k: {x: -sum(map(math.log, map(p, g))) / len(g) for x, p in models.items()} for k, g in grams.items() if g}
    usual, bound = {}, {}
    for lang in models:
        own = [(entropy[r["doc_id"]][lang], len(grams[r["doc_id"]])) for r in learn if r["lang"] == lang and grams[r["doc_id"]]]
        usual[lang] = sum(h * min(n, 500) for h, n in own) / sum(min(n, 500) for _, n in own)
        excess = sorted((h - usual[lang]) * math.sqrt(n) for h, n in own)
        bound[lang] = max(8.0, language_id.MARGIN * excess[math.ceil(0.999 * len(excess)) - 1])
    out = {}
    for k, g in grams.items():
        if not g:
            out[k] = ("und", True)
            continue
        best = min(models, key=lambda x: (entropy[k][x], x))
        h = entropy[k][best]
        out[k] = (best, (h - usual[best]) * math.sqrt(len(g)) > bound[best] and h > language_id.LEAST_RATIO * usual[best])
    return out


def shingles(text: str | None) -> set[tuple[str, ...]]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts: dict[int, str | None]) -> dict[int, int]:
    """The least doc_id reachable over links of 75 %, all pairs compared."""
    sets = {k: shingles(t) for k, t in texts.items()}
    part = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return part


def secrets(text: str | None) -> list[tuple[int, int]]:
    """Places of the base kinds, and of weaker parts that complementary ones stand beside."""
    text = text or ""
    spans = [(kind, m.start(), m.end(), m) for kind, pattern in secret_links.PATTERNS.items() for m in re.finditer(pattern, text)]
    spans = [x for x in spans if x[0] != "assign" or len(x[3].group(2)) >= 6]
    base = [x for x in spans if x[0] in secret_links.BASE]
    strong = lambda x: re.search("[0-9]", x[3].group()) and re.search("[A-Za-z]", x[3].group()) and not any(b[1] < x[2] and x[1] < b[2] for b in base)
    spans = [x for x in spans if x[0] != "opaque" or strong(x)]
    near = lambda x, y: x[1] <= y[2] + 200 and x[2] >= y[1] - 200
    pairs = [(x, y) for x in spans if x[0] in ("access", "ident") for y in spans if y[0] in ("assign", "hex", "opaque") and near(y, x)]
    both = {x for p in pairs for x in p}
    ends = {x for x in spans if x[0] == "endpoint" and any(near(x, y) for y in both)}
    return sorted({(x[1], x[2]) for x in [*base, *both, *ends]})


def redacted(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = "", 0
    for start, end in secrets(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]

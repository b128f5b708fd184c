"""Brute-force versions of operators that SQL cannot express."""

import math
from collections import defaultdict

from dhruva.llm.canonical_names import NOISE, THRESHOLD, TIE, osa_many, skeleton, soft_tfidf, spellings, typed_words


def all_scores(values, forms, entries):
    """Every value against every entry, without signatures, look-ups or bounds."""
    by_entry, words = {}, defaultdict(list)
    for r in entries:
        words[r["entry_id"]].append((r["worth"], r["word"]))
    top = math.log(1 + len(words))
    edits = lambda f: (0 if len(f.lstrip("~")) < 4 else 1 if len(f.lstrip("~")) < 6 else 2)
    spelt_forms, near = [r["form"] for r in forms], {}

    def distances(unit):
        if unit not in near:
            near[unit] = osa_many([unit] * len(spelt_forms), spelt_forms)
        return near[unit]

    for v in values:
        typed = typed_words(v)
        hits = defaultdict(float)
        for i, w in enumerate(typed):
            for width, unit in [(1, u) for u in spellings(w)] + ([(2, skeleton(w + typed[i + 1]))] if i + 1 < len(typed) else []):
                for r, d in zip(forms, distances(unit)):
                    f, kind = r["form"], r["kind"]
                    if kind == "short" and unit == f:
                        sim = 0.95
                    elif kind == "code" and unit == skeleton(w) and len(typed) == 1 and w == f:
                        sim = 1.0
                    elif kind in ("word", "common", "glued") and f and d <= (min(1, edits(f)) if kind == "glued" else edits(f)):
                        sim = 1 - d / (2 * len(f))
                    else:
                        continue
                    if (width == 1 or kind == "word") and (kind != "glued" or width == 1):
                        k = (i, width, r["word"], kind, r["worth"], r["entry_id"])
                        hits[k] = max(hits[k], sim)
        spelt = [(p, n, w, k in ("common", "short"), x, sim) for (p, n, w, k, x, _), sim in hits.items() if w]
        free = [(i, w in NOISE or w.isdecimal() and len(w) < 3) for i, w in enumerate(typed)]
        scored = defaultdict(list)
        for e, own in words.items():
            scored[e].append(soft_tfidf(own, spelt, free, top))
        for (_, _, _, k, _, e), sim in hits.items():
            if k == "glued" or k == "code":
                scored[e].append((sim, 0.0, True))
        found = sorted((max(x for x in s if x[0] >= THRESHOLD), e) for e, s in scored.items() if any(x[0] >= THRESHOLD for x in s))
        best = found[-1][0] if found else None
        fits = [e for x, e in found if x[0] >= best[0] - TIE or not best[2] and x[1] >= best[1] - TIE]
        by_entry[v] = (found[-1][1] if len(fits) == 1 else None, len(fits))
    return by_entry


def groups(rows):
    """Rows (id, keys ...) to the least id of all that are joined by equal keys, at any remove."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, *keys in rows:
        for k, key in enumerate(keys):
            if key is not None:
                a, b = find(("id", i)), find((k, key))
                parent[max(a, b, key=repr)] = min(a, b, key=repr)
    return {i: find(("id", i)) for i, *_ in rows}

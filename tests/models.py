"""Sequential models of the rules, written for the tests alone."""

from __future__ import annotations

import re

# Kinds of labelled passages; what ends one.
KINDS = "определение|теорема|лемма|аксиома|следствие|утверждение|замечание|пример|алгоритм|задача|свойство|доказательство"
STOPS = "доказательство|заметим|покажем|таким образом|следовательно|отсюда|действительно|вернёмся|перейдём|рассмотрим|во многих|многие"


def regions(rows):
    """[(kind, text)] -> kept positions."""
    open_, out = False, []
    for i, (kind, text) in enumerate(rows):
        head = kind == "SectionHeader"
        item = head and re.match(r"(Задача|Упражнение)\s*\d+", text.strip())
        if open_ and (not head or item):
            continue
        open_ = False
        if kind in ("PageHeader", "PageFooter", "Footnote"):
            continue
        if head and ("Задачи" in text or "Упражнения" in text) and len(text) <= 15:
            open_ = True
            continue
        if len(text) + 4 * (kind in ("Equation", "Code")) > 3:
            out.append(i)
    return out


def paths(rows):
    stack, out = [], []
    for kind, text in rows:
        t = text.strip()
        if kind == "SectionHeader" and re.match(r"\d+(\.\d+)*\.?\s+\S", t):
            depth = len(t.split()[0].rstrip(".").split("."))
            stack = [x for x in stack if x[0] < depth] + [(depth, re.sub(r"^[\d.]+\s*", "", t).strip())]
        out.append(" > ".join(x[1] for x in stack))
    return out


def labels(rows):
    now, used, out = "", 0, []
    for kind, text in rows:
        t = text.strip()
        if kind != "Text":
            now = ""
            m = re.search(r"рис(?:унок)?\.?\s*(\d+(?:\.\d+)*)", t, re.I) if kind in ("FigureGroup", "PictureGroup") else None
            out.append(f"Рисунок {m[1]}" if m else "")
            continue
        if m := re.match(rf"({KINDS})[\s\xa0]+(\d+(?:\.\d+)*)", t, re.I):
            now, used = f"{m[1].capitalize()} {m[2]}", 0
        elif now and (used >= 6 or re.match(STOPS, t, re.I)):
            now = ""
        elif now:
            used += 1
        out.append(now)
    return out


def packed(rows, size=10):
    """[(path, label)] -> group numbers. Sections are cut apart first; in each, cut points follow from the lengths of its label runs."""
    out, number, at = [], 0, 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        labels_ = [label for _, label in rows[at:end]]
        fill, i = 0, 0
        while i < len(labels_):
            n = 1
            while labels_[i] and i + n < len(labels_) and labels_[i + n] == labels_[i]:
                n += 1
            full_before_run = fill >= size or fill + n > size
            if labels_[i] and fill and full_before_run:
                number, fill = number + 1, 0
            out += [number] * n
            fill += n
            if not labels_[i] and fill >= size:
                number, fill = number + 1, 0
            i += n
        number += fill > 0
        at = end
    return out

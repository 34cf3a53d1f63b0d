"""Chunkers over whole texts in plain Python: what the chunkers of tables are held against."""

from __future__ import annotations

import re
from collections.abc import Iterator

from heron.functions.chunking import CODE, LEAST, OVERLAP, SEPARATORS, SIZE


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Parts of at most `size` characters, cut behind the coarsest separator that serves."""
    if len(text) <= size or not separators:
        yield text
    elif not separators[0]:
        yield from (text[i : i + size] for i in range(0, len(text), size))
    else:
        for part in re.split(f"(?<={re.escape(separators[0])})", text):
            if part:
                yield from pieces(part, size, separators[1:])


def tail(text: str, overlap: int) -> str:
    """The last `overlap` characters, from the next word on."""
    if len(text) <= overlap:
        return text
    cut = text.find(" ", len(text) - overlap)
    return text[cut + 1 :] if cut >= 0 else text[-overlap:]


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Greedy chunks of pieces, joined by blanks, each beginning with the tail of the one before; a short last one joins its neighbour."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, now = [], ""
    for part in filter(None, map(str.strip, pieces(text, size))):
        if now and len(now) + len(part) + 1 > size:
            out.append(now)
            now = " ".join(filter(None, [tail(now, overlap) if overlap else "", part]))
        else:
            now = f"{now} {part}" if now else part
    if now and len(now) < least and out:
        out[-1] += " " + now
    elif now:
        out.append(now)
    return [" ".join(x.split()) for x in out]


def _pack(blocks: Iterator[tuple[str, str, tuple[str, ...]]], size: int, least: int) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """Neighbouring blocks of one kind and path joined up to `size`; larger ones are cut. Chunks under `least` characters are dropped, by definition of these chunkers; least=0 keeps all."""
    now: list[str] = []
    key = None
    for text, kind, path in [*blocks, ("", "end", ())]:
        whole = kind in ("fence", "table")
        if now and (key != (kind, path) or whole or sum(map(len, now)) + len(text) > size):
            joined = "\n".join(now)
            for x in [joined] if key[0] in ("fence", "table") else recursive(joined, size, 0, 0) if len(joined) > size else [joined]:
                if len(x) >= least:
                    yield x, *key
            now = []
        key = (kind, path)
        if text:
            now.append(text)


def markdown_blocks(text: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """Blocks of Markdown with their kind and the headers above them."""
    path: list[tuple[int, str]] = []
    fence, rows = None, []
    for line in text.split("\n"):
        mark = re.match(r"\s*(```|~~~)", line)
        if fence:
            rows.append(line)
            if mark and mark[1] == fence:
                yield "\n".join(rows), "fence", tuple(t for _, t in path)
                fence, rows = None, []
            continue
        kind = "fence" if mark else "table" if line.lstrip().startswith("|") else "header" if re.match(r"#{1,6} ", line) else "list" if re.match(r"\s*([-*+]|\d+[.)]) ", line) else "quote" if line.startswith(">") else "text" if line.strip() else "blank"
        if rows and kind != "table":
            yield "\n".join(rows), "table", tuple(t for _, t in path)
            rows = []
        if kind == "fence":
            fence, rows = mark[1], [line]
        elif kind == "table":
            rows.append(line)
        elif kind == "header":
            level = len(line) - len(line.lstrip("#"))
            path = [x for x in path if x[0] < level] + [(level, line.lstrip("#").strip())]
        elif kind != "blank":
            yield line, kind, tuple(t for _, t in path)
    if rows:
        yield "\n".join(rows), "fence" if fence else "table", tuple(t for _, t in path)


def code_blocks(text: str, language: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """Blocks of code: imports, definitions (from their first line to the next at the margin), and the rest."""
    begins, now, kind, name = re.compile(CODE[language]), [], "code", ()
    for line in text.split("\n"):
        imports = re.match(r"(import|from|#include|using|use|require|package)\b", line)
        starts = begins.match(line)
        if (imports and kind != "import") or starts or (kind == "import" and not imports and line.strip()):
            if any(x.strip() for x in now):
                yield "\n".join(now).strip("\n"), kind, name
            now, kind = [], "import" if imports else "definition" if starts else "code"
            name = (line.strip()[:80],) if starts else ()
        now.append(line)
    if any(x.strip() for x in now):
        yield "\n".join(now).strip("\n"), kind, name


def placed(text: str, chunks: Iterator[tuple[str, str, tuple[str, ...]]], overlap: int = 0) -> Iterator[tuple[tuple[str, str, tuple[str, ...]], tuple[int, int]]]:
    """Chunks with the places (start, end) of the text that they were made of, white space apart.

    A chunk differs from its text in white space only, so it is looked for among the text's other characters; it begins
    at most `overlap` characters before the end of the one before.
    """
    solid = [i for i, c in enumerate(text) if not c.isspace()]
    squeezed, after = "".join(text[i] for i in solid), 0
    for chunk in chunks:
        own = "".join(chunk[0].split())
        found = squeezed.find(own, after) if own else -1
        if found < 0:
            yield chunk, (0, 0) if not solid else (solid[min(after, len(solid) - 1)],) * 2
            continue
        after = found + max(0, len(own) - overlap)
        yield chunk, (solid[found], solid[found + len(own) - 1] + 1)

"""What each line of a Markdown text is, by CommonMark's block rules with tables: containers (quotes and list items) stay open while a line continues
them, and inside the innermost one a leaf (paragraph, fence, HTML block, table) may be open. One pass; its state is what is open."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Kinds of lines that yield nothing: they are no content of a record.
SILENT = ("blank", "code", "html", "definition", "lost", "mark", "more", "under", "rule")

HEADING = re.compile(r"(#{1,6})(?:[ ]+(.*?))?(?:[ ]+#+)?[ ]*$")
RULE = re.compile(r"(?:\*[ ]*){3,}$|(?:-[ ]*){3,}$|(?:_[ ]*){3,}$")
MARK = re.compile(r"([*+-]|\d{1,9}[.)])(?=[ ]|$)([ ]*)")
FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
UNDER = re.compile(r"(=+|-+)[ ]*$")
DEFINITION = re.compile(r"""\[(?:[^\[\]\\]|\\.)+\]:\s*(?:<[^<>]*>|[^\s<]\S*)(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*$""")
DASHES = re.compile(r"\|?[ ]*:?-+:?[ ]*(?:\|[ ]*:?-+:?[ ]*)*\|?[ ]*$")
PIPE = re.compile(r"(?<!\\)\|")
#: Fixed values of CommonMark: what begins an HTML block, and what ends it (None: a blank line).
BLOCK_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|"
    "html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
TAG = r"""(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"""
HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile("<!--"), re.compile("-->")), (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile("<![A-Za-z]"), re.compile(">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{BLOCK_TAGS})(?=\s|/?>|$)", re.I), None),
)
LOOSE = re.compile(TAG)
#: Containers that may be open inside each other; deeper ones are text.
DEEPEST = 100


class _Container:
    """A quote (width None) or a list item, whose content begins `width` columns on."""

    __slots__ = ("bare", "block", "mark", "ordered", "paragraphs", "row", "width")

    def __init__(self, width, mark, ordered, block, bare):
        self.width, self.mark, self.ordered, self.block, self.bare = width, mark, ordered, block, bare
        self.row, self.paragraphs = None, []


def cells(line: str) -> list[str]:
    """The cells of a table's row, outer bars aside."""
    parts = PIPE.split(line.strip())
    return parts[(parts[0].strip() == "" and len(parts) > 1) : len(parts) - (parts[-1].strip() == "" and len(parts) > 1)]


def classify(text: str) -> list[list]:
    """A text -> [line, kind, level, body, depth, ordered, block] of each line, lines as splitlines() has them.

    kind: heading, text, item, quote, row or break; those of SILENT yield nothing. body: the line's content; of an item all its paragraphs' lines, on the
    line where they begin, of a heading over `===` or `---` all its lines. depth: of an item in its list. ordered: whether the outermost list is.
    block: the number of the first line of the outermost list or quote, the paragraph or table.
    """
    rows: list[list] = []
    stack: list[_Container] = []
    paragraph: list[int] | None = None  # the numbers of its rows, while it is open
    fence: tuple[str, int] | None = None
    html: re.Pattern | bool = False  # what ends the HTML block; None for a blank line
    table: int | None = None
    items: list[_Container] = []
    for n, line in enumerate(text.splitlines(), 1):
        if stack:
            rows[-1][6] = stack[0].block
        rest, matched = line.expandtabs(4) if "\t" in line else line, 0
        for c in stack:
            body = rest.lstrip(" ")
            indent = len(rest) - len(body)
            if c.width is None:
                if indent > 3 or body[:1] != ">":
                    break
                rest = body[2:] if body[1:2] == " " else body[1:]
            elif not body.strip():
                if c.bare:
                    break
            elif indent >= c.width:
                rest = rest[c.width :]
            else:
                break
            c.bare = False
            matched += 1
        inside = matched == len(stack)
        row = [line, "", None, "", None, None, n]
        rows.append(row)
        if fence or html is not False:
            if inside:
                body = rest.strip(" ")
                row[1] = "code" if fence else "html"
                if fence:
                    if body and len(rest) - len(rest.lstrip(" ")) < 4 and len(body) >= fence[1] and not body.strip(fence[0]):
                        fence = None
                elif html is None and not body:
                    row[1], html = "blank", False
                elif html and html.search(rest):
                    html = False
                continue
            fence, html = None, False
        opened = False

        def close() -> None:
            nonlocal paragraph, table
            del stack[matched:]
            paragraph = table = None

        def told(kind: str, body: str = "") -> None:
            """What the line is outside all containers; in a quote it is the quote's, in an item nothing."""
            if not stack:
                row[1], row[3] = kind, body
            elif stack[0].width is None:
                row[1], row[3] = "quote", body
            else:
                row[1] = "lost"

        while True:
            body = rest.lstrip(" ")
            indent = len(rest) - len(body)
            first = body[:1]
            if not body.strip() or first.isalpha() and indent < 4:
                break
            if indent > 3:
                if paragraph is None or opened:
                    close()
                    row[1] = "code"
                break
            if inside and paragraph is not None and not opened:
                top = rows[paragraph[-1]][0]
                if first in "|:-" and DASHES.match(body) and "|" in top and len(cells(top)) == len(cells(body)):
                    head = paragraph.pop()
                    if stack and stack[-1].width is not None and stack[-1].paragraphs:
                        stack[-1].paragraphs[-1].pop()
                    if not stack:
                        rows[head][1], rows[head][6] = "row", head + 1
                    elif stack[0].width is not None:
                        rows[head][1] = "lost"
                    paragraph, table = None, head + 1
                    told("rule")
                    row[6] = table
                    break
                if first in "=-" and UNDER.match(body):
                    if not stack:
                        first_row = rows[paragraph[0]]
                        first_row[1:4] = "heading", 1 if first == "=" else 2, "\n".join(rows[i][3] for i in paragraph)
                        for i in paragraph[1:]:
                            rows[i][1] = "under"
                    elif stack[-1].width is not None and stack[-1].paragraphs:
                        stack[-1].paragraphs.pop()
                    paragraph = None
                    row[1] = "under"
                    break
            if first == ">" and len(stack) < DEEPEST:
                close()
                stack.append(_Container(None, ">", None, n, False))
                matched, opened = matched + 1, True
                rest = body[2:] if body[1:2] == " " else body[1:]
                continue
            if first == "#" and (found := HEADING.match(body)):
                close()
                told("heading", (found[2] or "").strip())
                row[2] = len(found[1])
                break
            if first in "`~" and (found := FENCE.match(body)):
                close()
                row[1], fence = "code", (first, len(found[1] or found[2]))
                break
            if first == "<":
                end = next((end for begin, end in HTML if begin.match(body)), False)
                if end is False and (paragraph is None or opened) and LOOSE.match(body):
                    end = None
                if end is not False:
                    close()
                    row[1], html = "html", False if end and end.search(body) else end
                    break
            if first in "*-_" and RULE.match(body):
                close()
                told("break")
                break
            found = MARK.match(body) if len(stack) < DEEPEST else None
            if found:
                mark, spaces, content = found[1], len(found[2]), body[found.end() :].strip() != ""
                if not (inside and paragraph is not None and not opened and (not content or mark[0].isdigit() and int(mark[:-1]) != 1)):
                    sibling = stack[matched] if matched < len(stack) and not opened else None
                    close()
                    wide = len(mark) + (spaces if content and spaces < 5 else 1)
                    same = sibling is not None and sibling.width is not None and sibling.mark == mark[-1]
                    own = _Container(indent + wide, mark[-1], mark[0].isdigit(), sibling.block if same else n, not content)
                    stack.append(own)
                    items.append(own)
                    matched, opened, row[1] = matched + 1, True, "mark"
                    rest = body[wide:]
                    continue
            break
        if row[1] and row[1] != "mark":
            continue
        body = rest.strip()
        if not body:
            if not opened:
                row[1] = "blank"
                if paragraph is not None or not inside or table:
                    close()
            continue
        if table and inside and not opened:
            told("row", body)
            row[6] = table
            continue
        if paragraph is None or opened:
            if not opened:
                close()
            if not stack and DEFINITION.match(body):
                row[1] = "definition"
                continue
            paragraph = []
            if stack and stack[-1].width is not None:
                stack[-1].paragraphs.append([])
        if not stack or stack[0].width is None:
            told("text", body)
            row[6] = paragraph[0] + 1 if paragraph else n
        elif any(c.width is None for c in stack):
            row[1] = "lost"
        else:
            own = stack[-1]
            own.paragraphs[-1].append(body)
            row[1] = "more"
            if own.row is None:
                own.row = n - 1
                row[1], row[4], row[5] = "item", len(stack) - 1, stack[0].ordered
        paragraph.append(n - 1)
    if stack:
        rows[-1][6] = stack[0].block
    for c in items:
        if c.row is not None:
            rows[c.row][3] = " ".join(x for p in c.paragraphs if (x := "\n".join(p))).strip()
            if not rows[c.row][3]:
                rows[c.row][1] = "lost"
    return rows


#: Lines of a batch.
LINES = 65_536


def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (file, text) -> file, ln (from 1) and what classify() tells."""
    names = ["file", "ln", "line", "kind", "level", "body", "depth", "ordered", "block"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32()]
    for batch in batches:
        out: list[tuple] = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out += [(file, i, *r) for i, r in enumerate(classify(text or ""), 1)]
            while len(out) >= LINES:
                part, out = out[:LINES], out[LINES:]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

"""Markdown, line by line: what converters leave in it, put right. Every function is linear in its text."""

from __future__ import annotations

import html

#: What may stand before a heading that runs on from the text.
_ENDS_TEXT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.,;:!?")
_PUNCTUATION = tuple(".,;:!?")
_BULLETS = frozenset("-•♦")
_NAME_MARKS = frozenset("&,'’() /-")
#: Characters of a name that became a heading, of a bold line, of a title after a number: least and most.
_NAME, _LINE, _TITLE = (3, 81), (3, 101), (3, 101)


def _capital(c: str) -> bool:
    return "A" <= c <= "Z" or "À" <= c <= "Ỹ"


def _in_name(c: str) -> bool:
    return c.isascii() and c.isalnum() or "À" <= c <= "ỹ" or c in _NAME_MARKS


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


# ---- whole texts

def opened(text: str) -> str:
    """Entities as characters, line breaks of HTML as such, and no line that only stands for a picture."""
    text = html.unescape(text) if "&" in text else text
    return "\n".join("" if _stands_for_picture(line) else line for line in _broken(text).split("\n"))


def _broken(text: str) -> str:
    out, at = [], 0
    while (i := text.find("<", at)) >= 0:
        end = text.find(">", i)
        if end < 0:
            break
        inside = text[i + 1 : min(end, i + 64)]
        is_break = inside[:2].lower() == "br" and inside[2:].strip() in ("", "/")
        out.append(text[at:i] + "\n" if is_break else text[at : i + 1])
        at = end + 1 if is_break else i + 1
    return "".join(out) + text[at:]


def _unstarred(line: str) -> str:
    """A line without the blanks, and up to two asterisks, at each end."""
    line = line.strip()
    for _ in range(2):
        line = line.removeprefix("*").removesuffix("*")
    return line.strip()


def _stands_for_picture(line: str) -> bool:
    if "<==" not in line:
        return False
    line = _unstarred(line)
    if not (line.startswith("==>") and line.endswith("<==")):
        return False
    name = line[3:].lstrip().lower()
    return name.startswith("picture") and not _word(name[7:8] or " ")


def without_images(text: str) -> str:
    """No ![name](target)."""
    out, at = [], 0
    while (i := text.find("![", at)) >= 0:
        close = text.find("]", i + 2)
        if close < 0:
            break
        end = text.find(")", close + 2) if text.startswith("(", close + 1) else -1
        shown = end > close + 2
        out.append(text[at:i] if shown else text[at : i + 2])
        at = end + 1 if shown else i + 2
    return "".join(out) + text[at:]


def without_tags(text: str) -> str:
    """No <name ...> and </name>; what is smaller than something else stays."""
    head, *pieces = text.split("<")
    out = [head]
    for piece in pieces:
        at = start = piece.startswith("/")
        while piece[at : at + 1].isascii() and (piece[at : at + 1].isalnum() or at > start and piece[at : at + 1] in (":", "-")):
            at += 1
        close = piece.find(">", at)
        tag = at > start and piece[start].isalpha() and close >= 0 and (close == at or piece[at].isspace())
        out.append(piece[close + 1 :] if tag else "<" + piece)
    return "".join(out)


# ---- lines

def headed(line: str) -> list[str]:
    """A heading, whatever stands between its marks and its text; what is bold after its text is a paragraph. No heading: none."""
    marks = len(line) - len(line.lstrip("#"))
    if not 1 <= marks <= 6 or not line[marks:].strip():
        return []
    rest, said = line[:marks], line[marks:].strip()
    if len(said) >= 4 and said.startswith("**") and said.endswith("**"):
        return [f"{rest} {said[2:-2]}"]
    star = said.find("*")
    if said.endswith("**") and said.startswith("**", star) and len(said) - star > 4 and 3 <= star <= 100:
        return [f"{rest} {said[:star].rstrip()}", "", said[star + 2 : -2]]
    return [f"{rest} {said}"]


def _is_name(text: str) -> bool:
    return _NAME[0] <= len(text) <= _NAME[1] and _capital(text[0]) and all(map(_in_name, text[1:]))


def run_in(line: str) -> list[str]:
    """A bold name in running text, with a blank after it, is a heading: lines before it, of it and after it."""
    out, start, at = [], 0, 0
    while (i := line.find("**", at)) >= 0:
        j, at = line.find("*", i + 2), i + 2
        if j < 0:
            break
        if not (j - i - 2 <= _NAME[1] and line.startswith("**", j) and line[j + 2 : j + 3].isspace() and _is_name(line[i + 2 : j])):
            continue
        end = i
        while end > start and line[end - 1].isspace():
            end -= 1
        if end > start and line[end - 1] in _ENDS_TEXT:
            out += [line[start:end], "", f"## {line[i + 2 : j]}", ""]
            start = j + 2
            while line[start : start + 1].isspace():
                start += 1
            at = start
    return [*out, line[start:]]


def bold_line(line: str) -> str | None:
    """The heading that a line of bold text alone is."""
    said = line.strip()
    inside = said[2:-2]
    whole = said.startswith("**") and said.endswith("**") and _LINE[0] <= len(inside) <= _LINE[1] and "*" not in inside
    return f"## {inside}" if whole and _capital(inside[0]) else None


def _unpaired(line: str, mark: str) -> str:
    """A line without the mark's pairs; an odd one, the last, stays."""
    parts = line.split(mark)
    return "".join(parts) if len(parts) % 2 else "".join(parts[:-1]) + mark + parts[-1]


def _unstressed(line: str) -> str:
    """No pairs of an asterisk that stands without another one beside it."""
    alone = [i for i, c in enumerate(line) if c == "*" and line[i - 1 : i] != "*" and line[i + 1 : i + 2] != "*"]
    gone = set(alone[: len(alone) // 2 * 2])
    return "".join(c for i, c in enumerate(line) if i not in gone) if gone else line


def _ununderlined(line: str) -> str:
    """No underscores around words; those inside of words stay."""
    at = [i for i, c in enumerate(line) if c == "_"]
    opens = [i for i in at if not (i and _word(line[i - 1])) and line[i + 1 : i + 2] != "_"]
    closes = [i for i in at if i and line[i - 1] != "_" and not _word(line[i + 1 : i + 2] or " ")]
    gone, c, end = set(), 0, -1
    for i in opens:
        if i <= end:
            continue
        while c < len(closes) and closes[c] <= i:
            c += 1
        if c == len(closes):
            break
        end = closes[c]
        gone |= {i, end}
    return "".join(x for i, x in enumerate(line) if i not in gone) if gone else line


def unmarked(line: str) -> str:
    """The text of a line without marks of stress."""
    for mark in ("**", "__"):
        line = _unpaired(line, mark) if mark in line else line
    line = _unstressed(line) if "*" in line else line
    line = _ununderlined(line) if "_" in line else line
    return _unpaired(line, "~~") if "~~" in line else line


def numbered(line: str) -> str:
    """An item of a list whose number lost its point: a number of one or two digits and a title."""
    bare = line.lstrip()
    if bare.startswith("-"):
        bare, dashed = bare[1:].lstrip(), True
    else:
        dashed = False
    digits = 0
    while digits < 2 and bare[digits : digits + 1].isdigit():
        digits += 1
    title = bare[digits:].lstrip()
    if not digits or not title or not _capital(title[0]):
        return line
    dash = title.find("-", _TITLE[0] + 1)
    while 0 <= dash and not (title[dash - 1].isspace() and title[dash + 1 : dash + 2].isspace()):
        dash = title.find("-", dash + 1)
    name = title[:dash].rstrip()
    if dash >= 0 and _TITLE[0] <= len(name) <= _TITLE[1]:
        return f"{bare[:digits]}. {name} - {title[dash + 1 :].lstrip()}"
    spaced = not dashed and bare[digits].isspace() and len(title) > 1
    return f"{bare[:digits]}. {title}" if spaced else line


def spaced(line: str) -> str:
    """No blank before punctuation, no two blanks in a row."""
    out: list[str] = []
    for c in line:
        if c in _PUNCTUATION:
            while out and out[-1].isspace():
                out.pop()
        elif c in " \t" and out and out[-1] in " \t":
            out[-1] = " "
            continue
        out.append(c)
    return "".join(out)


def bulleted(line: str) -> str:
    bare = line.lstrip()
    return f"- {bare[1:].lstrip()}" if bare[:1] in _BULLETS and bare else line


def _last(lines: list[str]) -> str:
    """The last character that is no blank, of lines of which the last ones may be empty."""
    for line in reversed(lines):
        if line and not line.isspace():
            return line.rstrip()[-1]
    return ""


def scanned(text: str) -> str:
    """Headings, names that are headings, stress, numbers and bullets of a whole text. A bold name that is a line of its own
    stands apart from the text before it; a line that starts with punctuation belongs to the one before it."""
    out: list[str] = []  # each line with the break before it, and what was joined to a line after it
    for raw in without_tags(without_images(text)).split("\n"):
        for said in headed(raw) or [raw]:
            for piece in run_in(said):
                heading = bold_line(piece)
                line = bulleted(spaced(numbered(unmarked(heading or piece))))
                if heading and _is_name(heading[3:]) and _last(out) in _ENDS_TEXT:
                    out += ["\n", f"\n{line}", "\n"]
                elif line.lstrip().startswith(_PUNCTUATION) and _last(out):
                    while not out[-1].strip():
                        out.pop()
                    out[-1] = out[-1].rstrip()
                    out.append(line.lstrip())
                else:
                    out.append(f"\n{line}")
    return "".join(out)[1:]

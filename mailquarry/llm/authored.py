"""Problem 4: quoted history and signatures in e-mails.

A semi-Markov model over the lines of a body.  A segment is authored (A),
quoted with marks (M), quoted without marks (U), signature (S) or disclaimer
(D).  A segmentation scores the sum of its segments: cues of each line, the cue
at the boundary where the segment starts, the length of the segment, features of
the span as a whole, and the step from the label before.  Viterbi decoding finds the best
segmentation; segments start only where a boundary cue or a blank line stands.
The weights are set by hand: there are no labelled lines to fit them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mojibake import READ_AS, _encode

A, M, U, S, D = range(5)
LABELS = ("authored", "quoted", "quoted", "signature", "disclaimer")

#: Cue classes of a line.
BLANK, MARK, ATTR, ORIG, HEAD, CLOSE, RULE, NAME, TITLE, CONTACT, NOTE, NOTICE, LINK, GREET, SHORT, TEXT = range(16)

# Formulas by which cues are known, in the languages of the corpus.
CLOSINGS = r"(?:kind|best|warm|many|with best)? ?(?:regards|wishes|thanks)|best|cheers|thank you|yours (?:sincerely|faithfully|truly)|sincerely|mit (?:freundlichen|besten) gr\S+|(?:viele|beste|liebe|herzliche|sch\S+ne) gr\S+|vielen dank|danke|meilleures salutations|bien (?:à|\S+) vous|(?:bien )?cordialement|merci|un (?:cordial )?saludo|(?:cordiales )?saludos|atentamente|gracias|abra\S+os|atenciosamente|obrigad[oa]|(?:com os melhores )?cumprimentos|(?:serdecznie )?pozdrawiam|z powa\S+aniem|dzi\S+kuj\S+|с уважением|спасибо|всего доброго|с наилучшими пожеланиями"
NOTES = r"sent (?:from|via|with) (?:my|the|a|web|mobile)\b.{0,60}|get the mail app.{0,40}|get outlook for .{0,20}|(?:von meinem|gesendet von mein|envoyé de(?:puis)? mon|enviado (?:desde|do) m|wysłano z |отправлено с ).{0,50}"
VERBS = r"(?:wrote|writes|schrieb|(?:a )?écrit|escribió|escribiÃ³|escribi\S{1,3}|escreveu|napisał(?:\(a\)|a)?|napisa\S{1,3}(?:\(a\))?|пишет|написал(?:\(а\)|а)?)"
ORIGINALS = r"-{3,} ?[^-=_].{1,60}[^-=_] ?-{3,}|begin forwarded message:|(?:anfang|début|inicio|início) .{3,40}:|_{3,} ?(?:original message|forwarded).{0,20}_{0,}"
NOTICES = r"confidentiality notice|disclaimer\b|legal notice|this (?:e-?mail|message|communication)(?: and any (?:files|attachments))? (?:may|is|are|contains)|the (?:contents|information) (?:of|in) this (?:e-?mail|message)|if you are not the intended recipient|please consider the environment|\S+ \S+(?: \S+)? accepts no liability|diese (?:nachricht|e-?mail) ist vertraulich|ce (?:message|courriel) est confidentiel|este (?:mensaje|correo) es confidencial|esta mensagem \S+ confidencial|(?:ta )?wiadomo\S+ jest poufna|это (?:сообщение|письмо) конфиденциально|unsubscribe|you (?:are receiving|received) this (?:e-?mail|message) because"
GREETINGS = r"(?:dear|hello|hi|hey|good (?:morning|afternoon|evening|day)|liebe[rs]?|hallo|guten|sehr geehrte\w*|bonjour|bonsoir|chers?|chère?s?|madame|hola|buenos|buenas|estimad[oa]s?|querid[oa]s?|olá|ol\S|bom dia|boa|prezad[oa]s?|caros?|cześć|cze\S+|dzień|dzie\S+ dobry|szanown\w+|drodzy|здравствуйте|добрый|уважаем\w+|привет)\b"

_CLOSE = re.compile(rf"(?:{CLOSINGS})\s*[,.!]?$", re.I)
_NOTE = re.compile(rf"(?:{NOTES})$", re.I)
_ATTR = re.compile(rf"^.{{0,160}}\b{VERBS}(?: (?:on|am|le|el|em)\b.{{4,40}}| \S.{{2,90}}[>)\]\w])? ?:$", re.I)
_VERB = re.compile(rf"\b{VERBS}\b", re.I)
_WRAPPED = re.compile(rf"^.{{0,160}}\b(?:wrote|writes|schrieb|écrit|escribió|escreveu|napisał(?:\(a\))?|пишет)(?: (?:on|am|le|el|em)(?: .{{0,30}})?)?$", re.I)
_ORIG = re.compile(rf"^(?:{ORIGINALS})$", re.I)
_HEAD = re.compile(r"^\*?[^\W\d_]{1,14}:\*? +\S", re.I)
_HEADKEY = re.compile(r"^\*?(?:from|sent|to|subject|date|cc|reply-to|von|gesendet|an|betreff|datum|de|envoyé|à|objet|enviado|para|asunto|fecha|enviada|assunto|data|od|wysłano|do|temat|от|отправлено|кому|тема|дата|копия):\*? +\S", re.I)
_RULE = re.compile(r"^(?:[-=_*~—–#]{2,}|—|–|[-=_*~] ?(?:[-=_*~] ?)+)$")
_ADDRESS = re.compile(r"\S+ ?(?:@|[\[(] ?at ?[\])]) ?\S+")
_CONTACT = re.compile(r"^(?:(?:t|tel|tel\.|phone|mobile|mob|m|fax|f|e|mail|e-?mail|web|w|www|skype|telefon|tél|móvil)\b[.:]? ?)?(?:[+(]?\d[\d ()./\-]{5,}\d(?: ?(?:ext\.?|x) ?\d+)?|\S+ ?(?:@|[\[(] ?at ?[\])]) ?\S+(?: ?[\[(] ?dot ?[\])] ?\S+)*)$", re.I)
_LINK = re.compile(r"^<?(?:https?://|www\.)\S+>?$", re.I)
_NOTICE = re.compile(rf"^(?:{NOTICES})", re.I)
_GREET = re.compile(rf"^(?:{GREETINGS})[^.?]{{0,60}}[,:!]?$", re.I)
_CALL = re.compile(r"^[^\W\d_][\w’'\-]+,$")
_NAMEWORD = r"(?:[^\W\d_a-zà-ÿа-я][^\W\d_]*(?:[’'\-][^\W\d_]+)*|[^\W\d_]\.)"
_NAME = re.compile(rf"^{_NAMEWORD}(?: {_NAMEWORD}){{0,3}}$|^{_NAMEWORD}(?:-\w+)?, {_NAMEWORD}(?: {_NAMEWORD})?$")
_TITLE = re.compile(r"^[^\W\d_][^.?!:]{2,50}(?: \||,) [^\W\d_][^.?!:]{2,50}$")
_PLACE = re.compile(r"^(?:\d{1,5}[A-Z]? [^.?!:]{4,60}|(?:flat|apt|unit) \d.{5,60}|[^\W\d_][\w .\-]{3,30} \d{1,4}[A-Za-z]?, .{3,40}|.{3,60}, [A-Z]{2} \d{5}|.{3,40} [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})$", re.I)
#: A greater-than sign before a number is a comparison, not a mark.
_GREATER = re.compile(r"^> ?\d[\d.,]* ?(?:%|percent|per cent|prozent|pour cent|por ciento|por cento|procent|процент)", re.I)


_HOST = re.compile(r"^(?:https?://)?www\.[\w.\-]+/?$", re.I)
_GARBLED = re.compile("[ÂÃÄÅĂĐÐÑÎÏâРСВГ√├┼╨╤‚¬][^\x00-\x7f]|[À-ÿ]{3}")


def _readable(line: str) -> str:
    """The line as it was written, where it was read in a wrong encoding as a whole."""
    for _ in range(2):
        for codec in READ_AS:
            try:
                fixed = _encode(line, codec).decode("utf-8")
            except (UnicodeError, ValueError):
                continue
            if fixed != line:
                line = fixed
                break
        else:
            break
    letters = [c for c in line if c.isalpha()]
    if letters and sum("À" <= c <= "ÿ" for c in letters) > 0.7 * len(letters):
        try:
            line = line.encode("cp1252").decode("cp1251")
        except UnicodeError:
            pass
    return line


def _cue(line: str, first: bool) -> int:
    if not line.isascii() and _GARBLED.search(line):
        line = _readable(line).strip() or line
    n = len(line)
    c = line[0]
    if c in ">|" or (c == ":" and (n == 1 or line[1] in " :")):
        return MARK
    if n <= 200 and line[-1] == ":" and _ATTR.match(line):
        return ATTR
    if n > 120:
        return NOTICE if _NOTICE.match(line) else TEXT
    if c in "-=_*~—–#b[BbAIDd" and (_RULE.match(line) or _ORIG.match(line)):
        return RULE if _RULE.match(line) else ORIG
    if _LINK.match(line):
        return LINK
    if _NOTICE.match(line):
        return NOTICE
    if n <= 70:
        if _CLOSE.match(line):
            return CLOSE
        if _NOTE.match(line):
            return NOTE
        if _CONTACT.match(line):
            return CONTACT
        if _HEADKEY.match(line):
            return HEAD
        if _GREET.match(line) or _CALL.match(line):
            return GREET
        if _NAME.match(line):
            return NAME
        if line[-1] not in ".?!:;,":
            if _PLACE.match(line):
                return CONTACT
            if _TITLE.match(line):
                return TITLE
        if n <= 40 and line[-1] not in ".?":
            return SHORT
    return TEXT


def cues(lines: list[str]) -> list[int]:
    """Cue class of every line, with what neighbouring lines tell."""
    out = [_cue(x, k == 0) if (x := raw.strip()) else BLANK for k, raw in enumerate(lines)]
    n = len(out)
    for k in range(n):
        c = out[k]
        if c == MARK:
            alone = (k == 0 or out[k - 1] != MARK) and (k + 1 == n or out[k + 1] != MARK)
            if alone and _GREATER.match(lines[k]) and (k == 0 or out[k - 1] != ATTR):
                out[k] = TEXT
            elif k and out[k - 1] != MARK and out[k - 1] != BLANK:
                # the lines before marked lines that introduce them
                last = lines[k - 1].strip()
                if last.endswith(":") and out[k - 1] not in (ATTR, HEAD, ORIG, GREET):
                    top = k - 1
                    while top > 0 and out[top - 1] not in (BLANK, MARK) and k - top < 3:
                        top -= 1
                    text = " ".join(lines[top:k])
                    if (top == 0 or out[top - 1] in (BLANK, MARK)) and (_VERB.search(text) or _ADDRESS.search(text) or (re.search(r"\d", text) and len(text) < 160)):
                        out[top:k] = [ATTR] * (k - top)
                elif out[k - 1] == ATTR and k > 1 and out[k - 2] not in (BLANK, MARK, ATTR) and len(last) < 60 and (k == 2 or out[k - 3] in (BLANK, MARK)):
                    out[k - 2] = ATTR
                elif last == ":" or (out[k - 1] not in (ATTR,) and _WRAPPED.match(last)):
                    out[k - 1] = ATTR
        elif c == LINK and k and out[k - 1] in (NAME, TITLE, CONTACT, CLOSE) and _HOST.match(lines[k].strip()):
            out[k] = CONTACT  # a bare site under a name
        elif c == ATTR and k and out[k - 1] not in (BLANK, MARK, ATTR) and len(lines[k].strip()) < 60 and (k == 1 or out[k - 2] in (BLANK, MARK)):
            if _ADDRESS.search(lines[k - 1]) or re.search(r"\d", lines[k - 1]):
                out[k - 1] = ATTR  # wrapped
        if out[k] not in (BLANK, MARK, HEAD, CONTACT, ATTR) and k + 1 < n and _HEAD.match(lines[k].strip()) and (_HEAD.match(lines[k + 1].strip()) or (k and out[k - 1] == HEAD)):
            near = lines[k] + lines[k + 1] + (lines[k - 1] if k else "")
            if _ADDRESS.search(near) or out[k + 1] == HEAD or (k and out[k - 1] == HEAD):
                out[k] = HEAD
        if out[k] in (SHORT, NAME, GREET, TITLE) and k > 1 and out[k - 1] == BLANK and k + 1 < n:
            # a short line right above a rule or a name closes the text, in any language
            after = _cue(lines[k + 1].strip(), False) if lines[k + 1].strip() else BLANK
            if out[k] == SHORT and after in (RULE, NAME):
                out[k] = CLOSE
    return out


#: Weight of a cue under each label (A, M, U, S, D).
EMIT = {
    BLANK: (0, 0, 0, 0, 0),
    MARK: (-9, 4, -1, -9, -9),
    ATTR: (-7, 1, 1, -6, -6),
    ORIG: (-8, -2, 2, -4, -4),
    HEAD: (-5, -2, 2, -3, -4),
    CLOSE: (-4, -6, 0, 3, -3),
    RULE: (-5, -6, 0, 2, 2),
    NAME: (-1, -6, 0, 2, -2),
    TITLE: (-0.5, -6, 0, 1.5, -1),
    CONTACT: (-1.5, -6, 0, 2, -1),
    NOTE: (-6, -6, 0, 3, 0),
    NOTICE: (-6, -6, 0, -2, 4),
    LINK: (1.5, -6, 0, -2, -3),
    GREET: (1, -6, 0, -1, -4),
    SHORT: (0.3, -6, 0, -0.7, 0),
    TEXT: (1, -6, 0.2, -3, 0.1),
}
#: Weight of the cue that a segment starts with; what is missing is impossible.
START = {
    M: {MARK: 0, ATTR: 2},
    U: {ORIG: 3, HEAD: 0, ATTR: 0},
    S: {CLOSE: 2, RULE: 0, NAME: -1, TITLE: -4, CONTACT: -4, NOTE: 2},
    D: {NOTICE: 2, RULE: 0, TEXT: -7, SHORT: -7, TITLE: -7, NAME: -8},
}
#: Step from a label (row) to the next (column).
STEP = (
    (-1, 0, 0, 0, 0),
    (0, -1, -1, -1, -1),
    (-9, -3, 0, -1, 0),
    (-5, 0, 0, -1, 0),
    (-6, 0, 0, -3, 0),
)
#: Lines that a segment usually has at most; each further line costs, up to LENGTH in all.
LONGEST = {S: (8, 1.0), D: (9, 0.5)}
LENGTH = 16.0


def _starts(cue: list[int]) -> list[int]:
    """Lines where a segment may start."""
    out = [0]
    for k in range(1, len(cue)):
        c, before = cue[k], cue[k - 1]
        if c == BLANK:
            continue
        if before == BLANK or (c == MARK) != (before == MARK) or c in (ORIG, NOTICE, NOTE, CLOSE, RULE, ATTR) or (c == HEAD and before != HEAD):
            out.append(k)
    return out


def decode(lines: list[str]) -> list[tuple[int, int, int]]:
    """Best segmentation of the lines: (start, end, label)."""
    cue = cues(lines)
    n = len(lines)
    if all(c in (TEXT, BLANK, GREET, LINK, SHORT) for c in cue):
        return [(0, n, A)]
    starts = _starts(cue)
    ends = [*starts[1:], n]
    total = [[0.0] * 5]
    seen = [(0, 0, 0, 0, 0, 0)]  # lines that are not blank, marked, header, notice, text, below a notice so far
    below = False
    for c in cue:
        e, t, p = EMIT[c], total[-1], seen[-1]
        # a notice goes on to the end of its paragraph, however long: its lines count as much as they would as text
        below = c != BLANK and (below or c == NOTICE)
        on = below and c in (TEXT, SHORT, NAME, TITLE)
        total.append([t[0] + e[0], t[1] + e[1], t[2] + e[2], t[3] + e[3], t[4] + (max(e[0], e[4]) if on else e[4])])
        seen.append((p[0] + (c != BLANK), p[1] + (c == MARK), p[2] + (c == HEAD), p[3] + (c == NOTICE), p[4] + (c in (TEXT, NAME, SHORT, LINK, GREET)), p[5] + on))
    # For each label the starts that may still win.  What a span adds lies within
    # SPAN, so a start that is further behind than that never will.
    alive: list[list[tuple[float, int, tuple | None]]] = [[], [], [], [], []]
    best: list[list[float | None]] = []
    back: list[list[tuple | None]] = []
    for i, k in enumerate(ends):
        s = starts[i]
        first = next((c for c in cue[s:k] if c != BLANK), BLANK)
        row: list[float | None] = [None] * 5
        link: list[tuple | None] = [None] * 5
        for label in range(5):
            begin = 0.0 if label == A else START[label].get(first)
            mine = alive[label]
            if begin is not None:
                if i == 0:
                    mine.append((begin - (4.0 if label == S else 0.0) - total[s][label], s, None))
                else:
                    v, prev = max((p + STEP[x][label], -x) for x, p in enumerate(best[-1]) if p is not None)
                    mine.append((v + begin - total[s][label], s, (i - 1, -prev)))
            top = None
            for base, at, before in mine:
                score = base + total[k][label] + (_span(label, cue, at, k, n, seen) if label else 0.0)
                if top is None or score > top:
                    top, link[label] = score, (at, before)
            row[label] = top
            if len(mine) > 1:
                most = max(x[0] for x in mine) - SPAN
                alive[label] = [x for x in mine if x[0] >= most]
        best.append(row)
        back.append(link)
    state = (len(ends) - 1, max((p, -x) for x, p in enumerate(best[-1]) if p is not None)[1] * -1)
    out = []
    while state is not None:
        s, before = back[state[0]][state[1]]
        out.append((s, ends[state[0]], state[1]))
        state = before
    return out[::-1]


#: More than the features of a span can make of a difference (LENGTH and the largest marks on either side).
SPAN = 40.0


def _span(label: int, cue: list[int], s: int, k: int, n: int, seen: list[tuple]) -> float:
    """Length and features of a whole segment."""
    a, b = seen[s], seen[k]
    solid, marks, heads, notices, text, below = (y - x for x, y in zip(a, b))
    if label == M:
        return 0.0 if marks else -12.0
    while s < k and cue[s] == BLANK:
        s += 1
    first = cue[s]
    if label == U:
        if first == HEAD and heads < 2:
            return -12.0
        if first == ATTR and marks and MARK in [c for c in cue[s : s + 8] if c != BLANK][:3]:
            return -8.0
        return (2.0 if heads >= 2 else 0.0) + (0.5 if text else -0.5)
    most, each = LONGEST[label]
    score = -min(LENGTH, each * max(0, solid - (below if label == D else 0) - most))
    if label == S:
        span = [c for c in cue[s:k] if c != BLANK]
        if first == NAME:
            if any(c in (TITLE, CONTACT, NOTE) for c in span[1:]):
                score += 2.0
            elif k == n or cue[k] in (ATTR, ORIG, HEAD, NOTICE, RULE, NOTE):
                score += 1.0
            else:
                score -= 3.0
        if first == RULE and not any(c in (NAME, TITLE, CONTACT, NOTE, CLOSE) for c in span):
            score -= 4.0
        if first == CLOSE and len(span) == 1 and k < n and cue[k] == TEXT:
            score -= 3.0
        return score
    if not notices:
        score -= 6.0 if first == RULE else 1.0
    return score


_SENTENCE = r"(?<=[.!?…])\s+"
_FOLDED = re.compile(
    rf"\s+(?=[>|] )|{_SENTENCE}|\s+(?=(?:{NOTICES}))|\s+(?=-{{3,}} ?[^-\s])|(?<=[^-\s]-{{3}})\s+|(?<=-----)\s+"
    rf"|\s+(?=(?:{NOTES}))|\s+(?=(?:Tel|Phone|Mobile|Mob|Fax|Telefon|Direct|Office)\b[.:])|\s+(?=(?:Flat|Apt|Unit|Suite) \d)|\s+(?=\*?(?:From|Von|De|Od|От): )",
    re.I,
)
_FORMULA = re.compile(rf"(?:(?<=[.!?…,] )|^|(?<=\s)(?=(?i:{CLOSINGS}),))(?i:{CLOSINGS})(?=[,.!]? [^\W\d_a-zà-ÿа-я])[,.!]?\s*")
#: What introduces a message: a sentence with a date or an address that ends in a word of writing and a colon.
_INTRODUCES = re.compile(rf"(?:[^.!?…]|\.(?=\S)){{1,160}}?\b{VERBS}[^:.!?]{{0,60}}:\s+", re.I)


def unfold(body: str) -> list[str]:
    """Stretches of a body whose line ends are lost, cut where a cue may begin; joined they give the body again."""
    cuts = {0, len(body)}
    cuts.update(m.end() for m in _FOLDED.finditer(body))
    cuts.update(m.end() for at in sorted(cuts) if (m := _INTRODUCES.match(body, at)) and re.search(r"[\d@]", m[0]))
    for m in _FORMULA.finditer(body):
        if m[0][0].isupper():
            cuts |= {m.start(), m.end()}
    at = sorted(cuts)
    return [body[a:b] for a, b in zip(at, at[1:])]


def new_text(body: str) -> str:
    """The newly written part of a body, blank edges removed."""
    if "\n" in body.strip():
        lines, mark = body.split("\n"), "\n"
    else:
        lines, mark = [x for stretch in unfold(body.strip()) for x in (stretch, "")], ""
    return mark.join(mark.join(lines[s:e]) for s, e, label in decode(lines) if label == A).strip() if lines else ""


def unauthored_lines(body: str) -> list[int]:
    """Numbers (from 1) of the lines without newly written text; blank lines are none."""
    lines = body.split("\n")
    out = []
    for s, e, label in decode(lines):
        if label != A:
            out += [k + 1 for k in range(s, e) if lines[k].strip()]
    return out


def _filled(emails: DataFrame, key: str, body: str) -> DataFrame:
    return emails.select(key, F.col(body).alias("body")).where(F.col(key).isNotNull() & F.col("body").rlike(r"(?U)\S"))


def line_segments(emails: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """(key, line_no) of each line that holds nothing newly written.

    Null, empty and blank bodies and rows without a key give no row; a body of one line is one line.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, numbers = [], []
            for k, text in zip(pdf[key], pdf["body"]):
                got = unauthored_lines(text)
                ids += [k] * len(got)
                numbers += got
            yield pd.DataFrame({key: ids, "line_no": numbers})

    kind = emails.schema[key].dataType.simpleString()
    return _filled(emails, key, body).mapInPandas(run, f"`{key}` {kind}, line_no int")


def authored_text(emails: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """(key, authored): the newly written lines of each body, blank edges removed.

    Bodies whose white space was collapsed are cut into stretches at sentence ends
    and cues, and decoded by the same model.

    Null bodies stay null; bodies without new text give an empty text; rows
    without a key are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text in pdf["body"]:
                out.append(None if text is None else new_text(text))
            yield pd.DataFrame({key: pdf[key], "authored": out})

    kind = emails.schema[key].dataType.simpleString()
    return emails.where(F.col(key).isNotNull()).select(key, F.col(body).alias("body")).mapInPandas(run, f"`{key}` {kind}, authored string")

"""Personal data, secrets and links in texts. A vectorized helper finds spans in a text; what is counted or joined with them is Spark's.

A null text has no findings. Positions are code points from 0, ends excluded.
"""

from __future__ import annotations

import re
from datetime import date
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instructions that change what is allowed.
INSTRUCTIONS = {
    "approval_bypass": ["승인 없이", "승인을 생략", "bypass approval", "without approval"],
    "permission_escalation": ["권한을 무시", "권한 우회", "ignore permission", "bypass permission"],
    "forbidden_tool": ["shell 실행", "sql 실행", "run shell", "execute sql"],
    "policy_weakening": ["시스템 정책을 무시", "이전 지시를 무시", "ignore system policy", "ignore previous instructions", "forget previous instructions"],
    "hidden_prompt": ["시스템 프롬프트를 보여", "시스템 프롬프트를 출력", "reveal system prompt", "show system prompt"],
    "role_override": ["act as system", "developer message로 행동", "시스템 역할로 행동"],
}
#: The forms of personal data and of secrets.
FORMS = [
    ("personal_email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?=$|[^A-Z0-9.-]|\.+(?=[^A-Z0-9.-]|$))"),
    ("personal_phone", r"(?<!\d)(?:\+82[-. ]?)?0?1[016789][-. ]?\d{3,4}[-. ]?\d{4}(?!\d)"),
    ("personal_phone", r"(?<!\d)0(?:2|[3-6]\d|70|80)[-. ]?\d{3,4}[-. ]?\d{4}(?!\d)"),
    ("personal_phone", r"(?<!\d)\+\d(?:[-. ]?\d){7,14}(?!\d)"),
    ("resident_registration_number", r"(?<!\d)\d{6}[- ]?[1-4]\d{6}(?!\d)"),
    ("payment_card", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"),
    ("bank_account", r"(?i)(?:계좌(?:번호)?|account(?:\s+number)?)\s*[:#-]?\s*(?P<value>\d(?:[- ]?\d){8,15})(?!\d)"),
    ("credential", r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?(?:-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\Z)"),
    ("credential", r"\bAKIA[0-9A-Z]{16}\b"),
    ("credential", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("credential", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("credential", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("credential", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}"),
    ("credential", r"(?i)\b(?:api[_ -]?key|access[_ -]?token|auth[_ -]?token|api[_ -]?token|private[_ -]?token|client[_ -]?secret|secret|password)\s*[:=]\s*['\"]?[^\s'\"]{8,}"),
]
#: Names of fields and table columns that hold personal data.
FIELDS = {
    "이름": "personal_name", "성명": "personal_name", "실명": "personal_name", "person name": "personal_name", "full name": "personal_name",
    "주소": "personal_address", "home address": "personal_address", "postal address": "personal_address",
    "이메일": "personal_email", "email": "personal_email", "e-mail": "personal_email", "전화번호": "personal_phone", "연락처": "personal_phone", "phone": "personal_phone",
    "주민등록번호": "resident_registration_number", "주민번호": "resident_registration_number",
    "카드번호": "payment_card", "card number": "payment_card", "계좌번호": "bank_account", "account number": "bank_account",
}
#: Weights of the digits of a resident number.
RESIDENT_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
_FORMS = [(category, re.compile(form)) for category, form in FORMS]
#: The form of a line that gives a field's value, and of the line below a table's head.
_FIELD = re.compile(rf"(?im)^[ \t]*(?:>[ \t]*)*(?:(?:[-+*]|\d+[.)])\s+)?({'|'.join(map(re.escape, sorted(FIELDS, key=len, reverse=True)))})[ \t]*[:：][ \t]*([^\r\n]*)")
_RULE = re.compile(r"\s*\|?(?:\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*")


def _digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def _is_resident(s: str) -> bool:
    d = _digits(s)
    try:
        date((1900 if d[6] < 3 else 2000) + 10 * d[0] + d[1], 10 * d[2] + d[3], 10 * d[4] + d[5])
    except ValueError:
        return False
    return (11 - sum(x * w for x, w in zip(d, RESIDENT_WEIGHTS, strict=False)) % 11) % 10 == d[12]


def _is_card(s: str) -> bool:
    """13 to 19 digits, not all the same, whose sum with every second one from the right doubled ends in 0."""
    d = _digits(s)[::-1]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


_CHECKS = {"resident_registration_number": _is_resident, "payment_card": _is_card}


def _bare(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span without blanks around; none if it is blank or a line of underscores to fill in."""
    value = text[start:end]
    lead = len(value) - len(value.lstrip())
    return (start + lead, start + len(value.rstrip())) if value.replace("_", "").strip() else None


def _cells(line: str, start: int) -> list[tuple[int, int]]:
    """The spans between the bars of a table's line, without those outside its outer bars."""
    bars = [start - 1, *(start + i for i, c in enumerate(line) if c == "|"), start + len(line)]
    spans = [(a + 1, b) for a, b in zip(bars, bars[1:], strict=False)]
    return spans[line.startswith("|") : len(spans) - line.endswith("|")]


def _in_tables(text: str):
    columns, header, header_raw = {}, "", ""
    start = 0
    for raw in text.splitlines(keepends=True):
        line = raw.rstrip("\r\n")
        if "|" in header and _RULE.fullmatch(line):
            names = [text[a:b].strip().lower() for a, b in _cells(header, start - len(header_raw))]
            columns = {i: FIELDS[n] for i, n in enumerate(names) if n in FIELDS}
        elif not line.strip() or "|" not in line:
            columns = {}
        else:
            for i, (a, b) in enumerate(_cells(line, start)):
                if i in columns and (span := _bare(text, a, b)):
                    yield columns[i], *span
        header, header_raw = line, raw
        start += len(raw)


def _findings(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    lowered = text.lower()
    found = [(category, m.start(), m.end()) for category, marks in INSTRUCTIONS.items() for mark in marks for m in re.finditer(re.escape(mark), lowered)]
    for category, form in _FORMS:
        group = "value" if "value" in form.groupindex else 0
        found += [(category, *m.span(group)) for m in form.finditer(text) if _CHECKS.get(category, bool)(m.group(group))]
    found += [(FIELDS[m[1].lower()], *span) for m in _FIELD.finditer(text) if (span := _bare(text, *m.span(2)))]
    found += _in_tables(text)
    kept, upto = [], 0
    for category, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= upto:
            kept.append((category, start, end))
            upto = end
    return kept


def findings(text: Column | str) -> Column:
    """Spans (category, start, end) of instructions, personal data and secrets; of those that overlap the first, then the longest."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("category", "start", "end"), x, strict=True)) for x in _findings(t)])

    return F.pandas_udf(run, "array<struct<category:string,start:int,end:int>>")(text)


#: The images that may stand in a text, and what an image of elsewhere becomes.
_OWN_IMAGE = re.compile(r"(?i)data:image/(?:png|jpe?g|gif|webp)[;,]")
ELSEWHERE_IMAGE = "외부 이미지"
_SCHEME = re.compile(r"(?i)[a-z][a-z0-9+.-]*:|[/\\]{2}")
_LINK = re.compile(
    r"(?P<code>(?m:^(?P<fence>```+|~~~+)[^\n]*\n(?s:.*?)(?:^(?P=fence)[^\n]*$|\Z))|(?P<ticks>(?<!`)`+(?!`))(?s:.+?)(?<!`)(?P=ticks)(?!`))"
    r"|(?P<bang>!?)\[(?P<label>(?:[^\[\]\\]|\\.)*)\]\(\s*(?P<to><[^<>\n]*>|(?:[^\s()]|\([^\s()]*\))+)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>"
)


def _is_elsewhere(url: str) -> bool:
    plain = re.sub(r"[\x00-\x20]", "", url)
    return bool(_SCHEME.match(plain)) and not _OWN_IMAGE.match(plain)


def _target(m: re.Match) -> str | None:
    """Where a match leads if that is elsewhere."""
    if m["code"]:
        return None
    url = m["to"].strip("<>") if m["to"] else m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}"
    return url if _is_elsewhere(url) else None


def _neutral(text: str, keep: set) -> str:
    def put(m: re.Match) -> str:
        url = _target(m)
        if url is None or url in keep:
            return m[0]
        host = urlsplit(url.replace("\\", "/")).hostname or ""
        if m["auto"]:
            return host or m["auto"]
        label = ELSEWHERE_IMAGE if m["bang"] else m["label"].strip() and m["label"]
        return f"{label}({host})" if host and m["bang"] else f"{label} ({host})" if host and label else label or host

    while (new := _LINK.sub(put, text)) != text:  # an image may stand in a link's label
        text = new
    return text


def neutral_links(markdown: Column | str, keep: Column | str | None = None) -> Column:
    """The text with links and images that lead elsewhere as their label and host, but for addresses in keep (an array) and in code.
    Inline links and addresses in angle brackets count; links by reference are left."""

    def run(texts: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _neutral(t, set(() if k is None else k)) for t, k in zip(texts, kept, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(markdown, F.array().cast("array<string>") if keep is None else keep)


def outside_urls(markdown: Column | str) -> Column:
    """The different addresses elsewhere that a text's links and images lead to, in order of code points."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({u for m in _LINK.finditer(t or "") if (u := _target(m))}))

    return F.pandas_udf(run, "array<string>")(markdown)

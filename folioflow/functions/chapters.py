"""Recognise chapter titles in a line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Patterns, canonical titles with their aliases, and default numbers.
ENGLISH = "(?i)^(?:chapter|chap\\.?|ch\\.?)\\s*([0-9]+(?:[.-][0-9]+)*)\\s*[:.\\-]?\\s*(.*)$"
KOREAN = "^제?\\s*([0-9]+(?:[.-][0-9]+)*)\\s*장\\s*[:.\\-]?\\s*(.*)$"
NUMBERED = "^([0-9]+(?:[.-][0-9]+)*)\\s+(.+)$"
OUTLINE = "^([0-9]+|[A-Z])\\s+(.+)$"
TITLES: dict[str, list[str]] = {
    "Introduction": [],
    "Overview": [],
    "Specifications": [],
    "Opening and closing": [],
    "Seating and safety restraints": [],
    "Driver Adjustments": [],
    "Hybrid vehicle guide": ["Hybrid system overview", "Hybrid/Plug-in Hybrid system overview"],
    "Electric vehicle guide": [],
    "Controls and Features": ["Control and Features"],
    "Driver assistance guide": [],
    "Driving your vehicle": [],
    "What to do in an emergency": [],
    "Maintenance": [],
    "안전 주의 사항": [],
    "그림 목차": ["그림 목차/안전 주의 사항", "그림목차/안전 주의 사항"],
    "소개": ["서론"],
    "차량 정보": ["차량 살펴보기", "차량 개요"],
    "제원": ["차량 제원"],
    "차량 열림과 닫힘 장치": ["열림 및 닫힘", "개폐 장치"],
    "주행 준비": ["운전자 조절 장치"],
    "좌석 및 안전 장치": ["안전 장치"],
    "하이브리드 전용 기능": [],
    "차량 편의 장치": ["편의 장치", "조작 장치 및 편의 기능"],
    "운전자 보조 시스템": [],
    "시동 및 주행": [],
    "비상시 응급 조치": ["비상시 응급조치"],
    "정기 점검": [],
}
NUMBERS: dict[str, str] = {
    "Introduction": "1",
    "Overview": "2",
    "Specifications": "3",
    "Opening and closing": "4",
    "Driver Adjustments": "5",
    "Seating and safety restraints": "6",
    "Hybrid vehicle guide": "7",
    "Electric vehicle guide": "7",
    "Hybrid system overview": "7",
    "Hybrid/Plug-in Hybrid system overview": "7",
    "Controls and Features": "8",
    "Driving your vehicle": "9",
    "Driver assistance guide": "10",
    "What to do in an emergency": "11",
    "Maintenance": "12",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _aliases() -> dict[str, str]:
    found = {}
    for title, others in TITLES.items():
        for name in (title, *others):
            found[name.lower()] = title
    return found


def _known(title: Column) -> Column:
    return _map(_aliases())[F.lower(title)]


def _chapter(title: Column, number: Column) -> Column:
    return F.struct(title.alias("title"), number.alias("number"))


def recognize_chapter(col: Column, outline: bool = False) -> Column:
    """struct(title, number) of a chapter heading, null when the line is none.

    Worded headings keep an unknown title; a bare number needs a known title, except in an outline,
    where number or letter plus any title is a chapter.
    """
    text = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), "\\s+", " ")

    def worded(pattern: str, known_only: bool = False) -> tuple[Column, Column]:
        title = strip(F.regexp_extract(text, pattern, 2))
        shown = _known(title) if known_only else F.coalesce(_known(title), title)
        found = F.when((title != "") & shown.isNotNull(), _chapter(shown, F.regexp_extract(text, pattern, 1)))
        return text.rlike(pattern), found

    bare = _known(text)
    bare_chapter = F.when(
        bare.isNotNull(),
        _chapter(
            bare,
            F.coalesce(_map({k.lower(): v for k, v in NUMBERS.items()})[F.lower(bare)], F.lit("")),
        ),
    )
    english, english_chapter = worded(ENGLISH)
    korean, korean_chapter = worded(KOREAN)
    _, numbered_chapter = worded(NUMBERED, known_only=True)
    # a worded heading without a title is no chapter at all; a numbered one may still be a bare title
    out = (
        F.when(english, english_chapter)
        .when(korean, korean_chapter)
        .otherwise(F.coalesce(numbered_chapter, bare_chapter))
    )
    if outline:
        matches, outline_chapter = worded(OUTLINE)
        out = F.when(matches, outline_chapter).otherwise(out)
    return out

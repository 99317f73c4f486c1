"""Times in words: relative expressions as dates, ranges of dates, weeks, and amounts in words."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days by their words, longer words first; and what a period counts for.
DAYS = {
    "the day before yesterday": -2, "the day after tomorrow": 2, "yesterday": -1, "tomorrow": 1, "today": 0,
    "大後天": 3, "大前天": -3, "大后天": 3, "後天": 2, "前天": -2, "后天": 2, "明天": 1, "明日": 1, "今天": 0, "今日": 0, "昨天": -1, "昨日": -1,
}
PERIODS = {"上個月": -30, "上个月": -30, "上月": -30, "下個月": 30, "下个月": 30, "下月": 30, "上週": -7, "上周": -7, "下週": 7, "下周": 7, "去年": -365, "明年": 365, "last week": -7, "next week": 7, "last month": -30, "next month": 30, "last year": -365, "next year": 365}
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365, "天": 1, "週": 7, "周": 7, "個月": 30, "个月": 30, "年": 365}
WEEKDAYS = {"monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5, "saturday": 6, "sunday": 7, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "日": 7, "天": 7}
DIGITS = {"一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}

_AGO_EN = re.compile(r"\b(\d+)\s*(day|week|month|year)s?\s*(ago|later)\b|\bin\s+(\d+)\s*(day|week|month|year)s?\b", re.I)
_AGO_ZH = re.compile(r"([\d一二兩两三四五六七八九十]+)\s*(天|週|周|個月|个月|年)(?:之|以)?([前後后])")
_WEEKDAY_EN = re.compile(rf"\b(last|next|this)\s+({'|'.join(k for k in WEEKDAYS if k.isascii())})\b", re.I)
_WEEKDAY_ZH = re.compile(r"([上下這本])(?:個)?(?:週|周|星期|禮拜)([一二三四五六日天])")
_WORDS = re.compile("|".join(rf"\b{re.escape(k)}\b" if k.isascii() else k for k in sorted((*DAYS, *PERIODS), key=len, reverse=True)), re.I)


def weekday(ref: date, which: int, weeks: int) -> date:
    """The day of the week (1: Monday) in the week of ref, `weeks` on."""
    return ref + timedelta(days=which - ref.isoweekday(), weeks=weeks)


def rewrite(text: str, ref: date) -> str:
    """The text with relative expressions as dates, counted from ref."""
    say = lambda days: (ref + timedelta(days=days)).isoformat()
    number = lambda s: int(s) if s.isdigit() else sum(DIGITS.get(c, 0) for c in s) if "十" not in s else 10 * (DIGITS.get(s.split("十")[0], 1) if s.split("十")[0] else 1) + (DIGITS.get(s.split("十")[1], 0) if s.split("十")[1] else 0)
    shift = {"last": -1, "next": 1, "this": 0, "上": -1, "下": 1, "這": 0, "本": 0}
    text = _WEEKDAY_EN.sub(lambda m: weekday(ref, WEEKDAYS[m[2].lower()], shift[m[1].lower()]).isoformat(), text)
    text = _WEEKDAY_ZH.sub(lambda m: weekday(ref, WEEKDAYS[m[2]], shift[m[1]]).isoformat(), text)
    text = _AGO_EN.sub(lambda m: say((-1 if m[3].lower() == "ago" else 1) * int(m[1]) * UNITS[m[2].lower()]) if m[1] else say(int(m[4]) * UNITS[m[5].lower()]), text)
    text = _AGO_ZH.sub(lambda m: say((-1 if m[3] == "前" else 1) * number(m[1]) * UNITS[m[2]]), text)
    return _WORDS.sub(lambda m: say(DAYS[m[0].lower()] if m[0].lower() in DAYS else PERIODS[m[0].lower()]), text)


def _month(ref: date, back: int) -> tuple[date, date]:
    year, month = divmod(ref.year * 12 + ref.month - 1 + back, 12)
    return date(year, month + 1, 1), date(year, month + 1, calendar.monthrange(year, month + 1)[1])


_RANGES: tuple[tuple[re.Pattern, Callable], ...] = (
    (re.compile(r"最近\s*(\d+)\s*天|past (\d+) days", re.I), lambda m, r: (r - timedelta(days=int(m[1] or m[2])), r)),
    (re.compile(r"最近\s*(\d+)\s*(?:週|周)|past (\d+) weeks", re.I), lambda m, r: (r - timedelta(weeks=int(m[1] or m[2])), r)),
    (re.compile(r"上半年"), lambda m, r: (date(r.year, 1, 1), date(r.year, 6, 30))),
    (re.compile(r"下半年"), lambda m, r: (date(r.year, 7, 1), date(r.year, 12, 31))),
    (re.compile(r"上一季|last quarter", re.I), lambda m, r: (_month(r, -((r.month - 1) % 3) - 3)[0], _month(r, -((r.month - 1) % 3) - 1)[1])),
    (re.compile(r"上(?:週|周)|last week", re.I), lambda m, r: (weekday(r, 1, -1), weekday(r, 7, -1))),
    (re.compile(r"[這本](?:週|周)|this week", re.I), lambda m, r: (weekday(r, 1, 0), weekday(r, 7, 0))),
    (re.compile(r"上[個个]?月|last month", re.I), lambda m, r: _month(r, -1)),
    (re.compile(r"本月|this month", re.I), lambda m, r: _month(r, 0)),
    (re.compile(r"去年|last year", re.I), lambda m, r: (date(r.year - 1, 1, 1), date(r.year - 1, 12, 31))),
    (re.compile(r"今年|this year", re.I), lambda m, r: (date(r.year, 1, 1), date(r.year, 12, 31))),
)


def spans(text: str, ref: date) -> tuple[date, date] | None:
    """The first and last day that a query's periods cover together, calendar periods whole; a single day counts as itself."""
    found = [f(m, ref) for p, f in _RANGES if (m := p.search(text))]
    if not found:
        days = [date.fromisoformat(x) for x in re.findall(r"\d{4}-\d{2}-\d{2}", rewrite(text, ref))]
        found = [(d, d) for d in days]
    return (min(a for a, _ in found), max(b for _, b in found)) if found else None


def week_shifted(text: str, span: tuple[date, date]) -> tuple[date, date]:
    """A single day, or a week from Monday that the text calls one, as the week from Sunday to Saturday."""
    a, b = span
    if a == b:
        a -= timedelta(days=a.isoweekday() % 7)
        return a, a + timedelta(days=6)
    if (b - a).days == 6 and re.search(r"週|周|星期|禮拜|礼拜|week", text, re.I):
        return a - timedelta(days=1), b - timedelta(days=1)
    return span


def resolved(kind: str, ref: datetime, direction: str | None = None, unit: str | None = None, quantity: int | None = None, weekday_: int | None = None, day_of_month: int | None = None) -> datetime | None:
    """The moment of a structured expression; None if it is vague or absolute already."""
    if kind == "relative" and unit and quantity is not None:
        sign = -1 if direction == "past" else 1
        if unit in ("second", "minute", "hour"):
            return ref + timedelta(**{f"{unit}s": sign * quantity})
        if unit in UNITS:
            return ref + timedelta(days=sign * quantity * UNITS[unit])
        if unit == "weekday" and weekday_:
            return ref + timedelta(days=weekday_ - ref.isoweekday(), weeks=sign)
    if kind == "recurring":
        if weekday_:
            return ref + timedelta(days=weekday_ - ref.isoweekday(), weeks=1)
        if day_of_month:
            year, month = ref.year, ref.month
            if not ref.day < day_of_month <= calendar.monthrange(year, month)[1]:
                year, month = divmod(ref.year * 12 + ref.month, 12)
                month += 1
            return ref.replace(year=year, month=month, day=min(day_of_month, calendar.monthrange(year, month)[1]))
    return None


def rewritten(df: DataFrame, column: str, ref: date) -> DataFrame:
    """rewrite() over a column, batch by batch."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else rewrite(t, ref))

    return df.withColumn(column, run(column))


# Amounts in words.
VAGUE = {"百": "~數百 TWD", "千": "~數千 TWD", "萬": "~數萬 TWD", "万": "~數萬 TWD"}
TENTHS = {c: f"~{10 * i}%" for i, c in enumerate("一二三四五六七八九", 1)}


def amounts(value: Column) -> Column:
    """Vague sums and shares in words, as figures; durations stay as they are."""
    for c, new in VAGUE.items():
        value = F.regexp_replace(value, f"幾十?{c}\\s*[塊块元]", new)
    for c, new in TENTHS.items():
        value = F.regexp_replace(value, f"{c}\\s*成", new)
    return F.regexp_replace(value, "[大約约]?[概]?\\s*一半", "~50%")


def amounts_sql(value: str) -> str:
    for c, new in VAGUE.items():
        value = f"regexp_replace({value}, '幾十?{c}\\s*[塊块元]', '{new}', 'g')"
    for c, new in TENTHS.items():
        value = f"regexp_replace({value}, '{c}\\s*成', '{new}', 'g')"
    return f"regexp_replace({value}, '[大約约]?[概]?\\s*一半', '~50%', 'g')"

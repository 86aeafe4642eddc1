"""Thresholds, as one frozen record, and word lists."""

from dataclasses import dataclass

# Stop words that queries and chunks drop.
STOP_WORDS = """
и в во на по с со к ко о об от из за до для при или не ни но а же ли бы
что как это той том эта эти тот этаже уже еще ещё его её их она они он мы вы ты
the and of to for in on a an or is be by as at from with this that
""".split()

# What tokens, clause numbers, tags and lines look like.
TOKEN = r"[0-9]+(?:\.[0-9]+)+|[a-zа-яё][a-zа-яё0-9]*[a-zа-яё0-9]|[0-9]{2,4}"
CLAUSE = r"[0-9]+(?:\.[0-9]+)+"
XML_NAME = r"</?([A-Za-z][A-Za-z0-9]*)[^>]*>"
XML_TAG = r"</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>"
URL = r"https?://[^ \t\n\r]+"
LEADER = r"\.{4,}|…{2,}"
FURNITURE = r"^(?:[0-9]{1,4}|страница[ \t]+[0-9]+[ \t]+из[ \t]+[0-9]+|стр\.?[ \t]*[ivxlcdm0-9]+|[0-9]+[ \t]*[-–—][ \t]*[0-9]+)$"
CYRILLIC_WORD = r"[А-Яа-яЁё]{5,}"


# Thresholds of admission, contents pages, chunks, ranking, gates and fusion.
@dataclass(frozen=True)
class Settings:
    min_chars: int = 40
    toc_lines: int = 6
    toc_leaders: int = 4
    toc_share: float = 0.4
    max_chunk: int = 1800
    k1: float = 1.5
    b: float = 0.75
    cover: float = 0.5
    soft_cover: float = 1 / 3
    strong: float = 10.0
    weak: float = 5.0
    rrf_k: int = 10
    pool: int = 50
    top_k: int = 3

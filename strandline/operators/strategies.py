"""Split strategies by name, a configuration with overrides, and the splitter as a table function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text


@dataclass(frozen=True)
class Config:
    """Settings of a split. Calls change a copy: with_changes()."""

    strategy: str = "sentence"
    least_chars: int = 8
    padding_us: int = 100_000
    boundary: str = "extend"
    longest_us: int = 30_000_000
    correct_us: int = 100_000

    def with_changes(self, **changes) -> Config:
        return replace(self, **changes)


PRESETS = {"default": Config(), "strict": Config(least_chars=16), "loose": Config(least_chars=4)}


def preset(name: str) -> Config:
    """A preset; an unknown name means the default."""
    return PRESETS.get(name, PRESETS["default"])


@dataclass(frozen=True)
class Strategy:
    """Whether a text is to be split, and its pieces (array of strings)."""

    name: str
    description: str
    should_split: Callable[[Column, Config], Column]
    split: Callable[[Column, Config], Column]


_known: dict[str, Strategy] = {}


def register(strategy: Strategy) -> None:
    _known[strategy.name] = strategy


register(Strategy("sentence", "at sentence ends", lambda c, k: text.splittable(c, k.least_chars), lambda c, k: text.sentences(c)))
register(Strategy("clause", "at clause ends", lambda c, k: text.count_of(c, text.CLAUSES) > 0, lambda c, k: text.clauses(c)))


def chosen(name: str) -> Strategy:
    if name not in _known:
        raise ValueError(f"no strategy {name}; there are {sorted(_known)}")
    return _known[name]


def split(df: DataFrame, column: str, config: Config = PRESETS["default"]) -> DataFrame:
    """A row for each piece (seg_no, piece) by the configured strategy; 'auto' takes, row by row, the
    first strategy that would split. Texts that none splits stay whole."""
    c = F.col(column)
    tried = list(_known.values()) if config.strategy == "auto" else [chosen(config.strategy)]
    pieces = F.coalesce(*[F.when(s.should_split(c, config), s.split(c, config)) for s in tried], F.array(c))
    return df.select("*", F.posexplode(pieces).alias("seg_no", "piece"))


def split_batch(df: DataFrame, column: str, named: str) -> DataFrame:
    """split(), each row by the preset that column `named` names, in any case; null and unknown names mean
    the default. `parted` tells whether the preset parts the text. One plan for all presets."""
    c, name = F.col(column), F.lower(F.col(named))
    known = F.when(name.isin(*PRESETS), name).otherwise("default")
    parted, pieces = F.lit(None).cast("boolean"), F.array(c)
    for preset_name, config in PRESETS.items():
        s, mine = chosen(config.strategy), known == preset_name
        parted = F.coalesce(parted, F.when(mine, F.coalesce(s.should_split(c, config), F.lit(False))))
        pieces = F.when(F.col("parted") & mine, s.split(c, config)).otherwise(pieces)
    # a column before the pieces: beside posexplode it would be evaluated, with the whole text, for each of them
    return df.withColumn("parted", parted).select("*", F.posexplode(pieces).alias("seg_no", "piece"))


def register_table_function(spark: SparkSession, name: str = "split_sentences") -> None:
    """The splitter for SQL: SELECT * FROM t, LATERAL split_sentences(text). Its body is SQL, so it stays in the plan."""
    spark.sql(
        rf"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS TABLE (seg_no INT, piece STRING)
        RETURN SELECT pos, col FROM posexplode(filter(transform(
            regexp_extract_all(trim(regexp_replace(value, r'[ \t\r\n\f]+', ' ')), r'{text.SENTENCE}', 0),
            p -> regexp_replace(p, r'^[ \t\r\n\f]+|[ \t\r\n\f]+$', '')), p -> length(p) > 0))"""
    )

"""The cleaning stage: ten rewrites in order, with counts, notes and output formats.

A null text stays null; a blank one gives an empty text and the note "Empty input text".
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import dates as D
from palaver.functions import rules as R
from palaver.functions import text as T

OUTPUT_FORMATS = ["raw_text", "sentence_list", "speaker_tagged", "structured"]


@dataclass(frozen=True)
class CleaningConfig:
    remove_timestamps: bool = True
    remove_diarization_noise: bool = True
    fix_speech_artifacts: bool = True
    remove_filler_words: bool = True
    remove_repetitions: bool = True
    normalize_numbers: bool = True
    normalize_dates: bool = True
    standardize_punctuation: bool = True
    remove_non_ascii: bool = True
    preserve_speaker_info: bool = True
    min_sentence_length: int = 3

    def __post_init__(self):
        if self.min_sentence_length < 1:
            raise ValueError("min_sentence_length must be at least 1")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> CleaningConfig:
        return cls(**data)

    def update(self, **changes) -> CleaningConfig:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise AttributeError(f"no such option: {sorted(unknown)}")
        return replace(self, **changes)


def steps(cfg: CleaningConfig, anchor: Column | str | None = None) -> list[tuple[str, object, str | None, object]]:
    """The rewrites that are on, in order: (name, rewrite, counter's name, counter). Dates need an anchor to be read against."""
    every = [
        ("timestamps", cfg.remove_timestamps, T.clean_timestamps, "timestamps_removed", lambda x: T.count_removed(x, R.TIMESTAMPS)),
        ("noise", cfg.remove_diarization_noise, T.clean_noise, "diarization_noise_removed", lambda x: T.count_removed(x, R.NOISE)),
        ("artifacts", cfg.fix_speech_artifacts, T.clean_artifacts, "artifacts_removed", lambda x: T.count_removed(x, R.ARTIFACTS)),
        ("fillers", cfg.remove_filler_words, T.clean_fillers, "filler_words_removed", lambda x: T.count_removed(x, [T.FILLER])),
        ("repetitions", cfg.remove_repetitions, T.collapse_repetitions, "repetitions_fixed", T.count_repetitions),
        ("numbers", cfg.normalize_numbers, T.spelled_numbers, None, None),
        ("ordinals", cfg.normalize_numbers, T.ordinals, None, None),
        ("dates", cfg.normalize_dates and anchor is not None, lambda x: D.normalize_in_text(x, anchor), None, None),
        ("punctuation", cfg.standardize_punctuation, T.punctuation_spacing, None, None),
        ("ascii", cfg.remove_non_ascii, T.ascii_cleanup, None, None),
    ]
    return [(name, step, counter, count) for name, on, step, counter, count in every if on]


COUNTERS = ["timestamps_removed", "diarization_noise_removed", "artifacts_removed", "filler_words_removed", "repetitions_fixed"]


def clean_text(c: Column | str, cfg: CleaningConfig = CleaningConfig(), anchor: Column | str | None = None) -> Column:
    """The cleaned text alone. Dates are normalised where an anchor is given to read them against."""
    x = T.col(c)
    for _, step, *_ in steps(cfg, anchor):
        x = step(x)
    return T.trim_ws(F.regexp_replace(x, rf"{R.WS}+", " "))


def clean(df: DataFrame, text_col: str, cfg: CleaningConfig = CleaningConfig(), anchor: Column | str | None = None) -> DataFrame:
    """df plus cleaned_text, sentence_list, original_length, cleaned_length, compression_ratio, removal counts and notes.

    Every rewrite is a projection of its own, so that the text before it serves both the rewrite and its counter.
    """
    t = F.col(text_col)
    out, counted = df.withColumn("_text", t), {}
    for _, step, counter, count in steps(cfg, anchor):
        if counter:
            out, counted[counter] = out.withColumn(counter, count(F.col("_text"))), True
        out = out.withColumn("_text", step(F.col("_text")))
    out = out.withColumns(
        {
            "cleaned_text": F.when(T.trim_ws(t) == "", "").otherwise(T.trim_ws(F.regexp_replace("_text", rf"{R.WS}+", " "))),
            "original_length": F.length(t),
            **{c: F.lit(0) for c in COUNTERS if c not in counted},
        }
    ).drop("_text")
    out = out.withColumns(
        {
            "sentence_list": T.long_sentences("cleaned_text", cfg.min_sentence_length),
            "cleaned_length": F.length("cleaned_text"),
            "compression_ratio": F.length("cleaned_text") / F.greatest(F.col("original_length"), F.lit(1)),
        }
    )
    return out.withColumn("processing_notes", notes(text_col))


def notes(text_col: str) -> Column:
    return F.when(T.trim_ws(text_col) == "", F.array(F.lit("Empty input text"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("compression_ratio") < 0.5, F.lit("Significant compression - possible over-cleaning")),
                F.when(F.size("sentence_list") < 3, F.lit("Very few sentences extracted")),
            )
        )
    )


def output(df: DataFrame, text_col: str, fmt: str = "structured", cfg: CleaningConfig = CleaningConfig(), anchor: Column | str | None = None) -> DataFrame:
    """One of OUTPUT_FORMATS; an unknown one means structured."""
    from palaver.operators.sentences import speaker_segments

    done = clean(df, text_col, cfg, anchor)
    if fmt == "raw_text":
        return done.select(*df.columns, "cleaned_text")
    if fmt == "sentence_list":
        return done.select(*df.columns, "sentence_list")
    if fmt == "speaker_tagged":
        keys = [c for c in df.columns if c != text_col]
        return speaker_segments(done, keys, "cleaned_text")
    return done

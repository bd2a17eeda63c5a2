"""Seams for what needs a model: speech recognition, person recognition and abstractive summaries.

A provider is a function on an iterator of pandas frames that loads its model once per worker process. Without one the
rules of this engine are used; nothing here imports a model library. An error of a row is caught and told in its columns.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LANGUAGES = ["auto", "en", "es", "fr", "de", "it", "pt", "ru", "ja", "ko", "zh", "ar", "hi"]
_LOADED: dict[str, object] = {}


def once(key: str, load: Callable[[], object]) -> object:
    """The model of this worker process, loaded at first use."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def clear_cache() -> None:
    _LOADED.clear()


FAILED = "[Summarization failed for this section]"


def summaries(df: DataFrame, text_col: str, load: Callable[[], Callable[[str], str]], key: str = "summary") -> DataFrame:
    """df plus summary and error; a failing row gets FAILED, a blank or null text an empty summary."""
    schema = StructType([*df.schema.fields]).add("summary", "string").add("error", "string")

    def run(batches):
        model = once(key, load)
        for b in batches:
            out, err = [], []
            for t in b[text_col]:
                if not isinstance(t, str) or not t.strip():
                    out.append("")
                    err.append(None)
                    continue
                try:
                    out.append(model(t))
                    err.append(None)
                except Exception as e:  # told per row, the job goes on
                    out.append(FAILED)
                    err.append(str(e))
            yield b.assign(summary=pd.Series(out, index=b.index, dtype=object), error=pd.Series(err, index=b.index, dtype=object))

    return df.mapInPandas(run, schema)


def transcripts(audio: DataFrame, load: Callable[[], Callable[[bytes, str], list[dict]]], key: str = "asr") -> DataFrame:
    """audio(path, content, ext) -> path, pos, start, end, text, error. Unsupported extensions give one row with an error."""
    from palaver.functions.rules import AUDIO_EXTENSIONS

    def run(batches):
        for b in batches:
            rows = []
            for path, content, ext in zip(b["path"], b["content"], b["ext"], strict=True):
                if ext not in AUDIO_EXTENSIONS:
                    rows.append((path, 0, None, None, None, f"unsupported extension {ext!r}"))
                    continue
                try:
                    segs = once(key, load)(bytes(content), ext)
                    rows += [(path, i, float(s["start"]), float(s["end"]), s["text"].strip(), None) for i, s in enumerate(segs)] or [(path, 0, None, None, None, "no speech")]
                except Exception as e:
                    rows.append((path, 0, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pos", "start", "end", "text", "error"])

    return audio.select("path", "content", F.lower("ext").alias("ext")).mapInPandas(run, "path string, pos int, start double, end double, text string, error string")


def shift_chunks(segments: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """segments(keys, chunk_no, start, end, text) moved by the start_time of their chunk, texts trimmed."""
    c = chunks.select(*keys, "chunk_no", "start_time")
    return segments.join(c, [*keys, "chunk_no"]).select(
        *keys, "chunk_no", (F.col("start") + F.col("start_time")).alias("start"), (F.col("end") + F.col("start_time")).alias("end"), F.trim("text").alias("text")
    )


# Sizes of the recognition models in MB, their speed and accuracy as labels.
RECOGNITION_MODELS = {
    "tiny": (39, "fastest", "lowest"), "base": (74, "fast", "good"), "small": (244, "medium", "better"), "medium": (769, "slow", "very good"),
    "large": (1550, "slowest", "best"), "large-v2": (1550, "slowest", "best"), "large-v3": (1550, "slowest", "best"),
}


def model_info() -> dict[str, tuple[int, str, str]]:
    """A copy, so that callers may change theirs."""
    return dict(RECOGNITION_MODELS)


def durations(audio: DataFrame) -> DataFrame:
    """audio(path, content) -> path, duration: seconds of WAV contents by their header; null for other kinds and broken ones."""

    @F.pandas_udf("double")
    def seconds(contents: pd.Series) -> pd.Series:
        out = []
        for b in contents:
            try:
                with wave.open(io.BytesIO(bytes(b))) as w:
                    out.append(w.getnframes() / w.getframerate() if w.getframerate() else None)
            except Exception:  # no WAV file
                out.append(None)
        return pd.Series(out, dtype="float64")

    return audio.select("path", seconds("content").alias("duration"))


def diarize(audio: DataFrame, load: Callable[[], Callable[[bytes, str], list[dict]]], key: str = "diarize") -> DataFrame:
    """audio(path, content, ext) -> path, segments, total_words, num_speakers, note (see speakers.diarized).

    The model gives the words of a recording with speaker; what it raises is told as a failed recording, the job goes on.
    """
    from palaver.operators import speakers
    from palaver.sources.checkpoints import cut

    said = transcripts(audio, lambda: _words_as_segments(load()), key)
    said = cut(said)  # the model runs once
    recordings = said.groupBy("path").agg(F.max(F.when(F.col("error") != "no speech", F.col("error"))).alias("error"))
    words = said.where("text is not null").select("path", "pos", F.nullif(F.split_part("text", F.lit("\u0001"), F.lit(1)), F.lit("")).alias("speaker"), F.split_part("text", F.lit("\u0001"), F.lit(2)).alias("text"))
    return speakers.diarized(recordings, words, ["path"])


def _words_as_segments(model: Callable[[bytes, str], list[dict]]) -> Callable[[bytes, str], list[dict]]:
    def run(content: bytes, ext: str) -> list[dict]:
        words = model(content, ext)
        return [{"start": w.get("start") or 0.0, "end": w.get("end") or 0.0, "text": f"{w.get('speaker') or ''}\u0001{(w.get('word') or '').strip()}"} for w in words]

    return run

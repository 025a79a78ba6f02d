"""Sinks: manifests, mixture folders, sweep tables, captions, small result files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.augment import export_captions, ratio_dir
from framewright.schema import write_manifest
from framewright.session import cut

__all__ = ["write_ablation", "write_caption_map", "write_captions", "write_csv", "write_fault_log", "write_frames", "write_manifest", "write_maps", "write_mixtures", "write_result", "write_scaling", "write_template", "table_text"]


def write_mixtures(mixtures: DataFrame, folder: str, layout: str = "partitioned") -> None:
    """Mixtures (columns ratio, mix_split). partitioned: Parquet by both, one job, pruned on read. folders: JSON
    Lines in ratio_0p25/train and so on, as training scripts expect them; the mixtures are computed once."""
    if layout == "partitioned":
        mixtures.write.mode("overwrite").partitionBy("ratio", "mix_split").parquet(folder)
        return
    if layout != "folders":
        raise ValueError(f"unknown layout: {layout}")
    mixtures = cut(mixtures)
    for r in mixtures.select("ratio", "mix_split").distinct().collect():  # a few
        part = mixtures.where((F.col("ratio") == r["ratio"]) & (F.col("mix_split") == r["mix_split"])).drop("ratio", "mix_split")
        write_manifest(part, f"{folder}/{ratio_dir(r['ratio'])}/{r['mix_split']}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_captions(clips: DataFrame, path: str, order: list[str]) -> None:
    """JSON Lines {name, caption}: one object a clip, so that it is written in parallel at any size."""
    export_captions(clips, order).select(F.col("out_name").alias("name"), "caption").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_caption_map(clips: DataFrame, path: str, order: list[str], at_most: int = 1_000_000) -> None:
    """One JSON object from name to caption, as training scripts read it, and beside it <path>.links, lines with the
    name and the clip that it stands for. It is a file of one machine: more than at_most clips are refused, write_captions
    has no bound."""
    rows = export_captions(clips, order).select("path", "out_name", "caption").limit(at_most + 1).toArrow()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} clips: write_captions")
    names = rows.column("out_name").to_pylist()
    Path(path).write_text(json.dumps(dict(zip(names, rows.column("caption").to_pylist(), strict=True)), ensure_ascii=False, indent=2))
    Path(f"{path}.links").write_text("".join(f"{n}\t{p}\n" for n, p in zip(names, rows.column("path").to_pylist(), strict=True)))


def write_maps(maps: DataFrame, path: str) -> None:
    """Dense per-frame results (path, frame_idx, shape array<int>, data binary of float16), such as flow fields and depth
    maps: those of a clip together and in order, as Parquet."""
    maps.repartition("path").sortWithinPartitions("path", "frame_idx").write.mode("overwrite").parquet(path)


def write_ablation(ratio_folders: dict[float, str], path: str, settings: dict | None = None) -> None:
    """The settings of a training run over mixtures: the ratios with the folder and captions of each, then `settings`
    (model, training, evaluation ...) as given."""
    dirs = [{"ratio": float(f"{r:.2f}"), "video_dir": f"{d}/videos", "captions": f"{d}/captions.json"} for r, d in sorted(ratio_folders.items())]
    write_template({"mixture_ablation": {"ratios": [x["ratio"] for x in dirs], "data_dirs": dirs}} | (settings or {}), path)


def write_scaling(rows: list[tuple[int, int, float]], path: str) -> list[dict]:
    """(workers, clips, seconds) of runs as a CSV with throughput, speedup and efficiency against the first row, which
    are returned as well."""
    base = rows[0][1] / rows[0][2] if rows else 1.0
    out = [{"num_workers": w, "n_clips": n, "elapsed_sec": round(s, 3), "clips_per_sec": round(n / s, 2), "speedup": round(n / s / base, 3), "efficiency_pct": round(100 * (n / s / base) / (w / rows[0][0]), 1)} for w, n, s in rows]
    text = [",".join(out[0])] + [",".join(str(v) for v in r.values()) for r in out] if out else []
    Path(path).write_text("\n".join(text) + "\n")
    return out


def write_fault_log(scored: DataFrame, path: str) -> dict[str, int]:
    """Counts of rows that were scored and of rows with an error, and the reasons with their counts, as a text file."""
    reasons = scored.groupBy("error").agg(F.count("*").alias("n")).orderBy(F.col("n").desc()).limit(1000).collect()
    out = {"processed": sum(r["n"] for r in reasons), "failed": sum(r["n"] for r in reasons if r["error"] is not None)}
    Path(path).write_text("\n".join([f"{k}: {v}" for k, v in out.items()] + [f"{r['n']} x {r['error']}" for r in reasons if r["error"] is not None]) + "\n")
    return out


def table_text(df: DataFrame, at_most: int = 1000) -> str:
    """A small report as a text table; further rows are counted in the last line."""
    rows = [[("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(at_most).collect()]
    wide = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)]
    lines = ["  ".join(x.rjust(w) for x, w in zip(r, wide, strict=True)) for r in [df.columns, ["-" * w for w in wide], *rows]]
    more = df.count() - len(rows) if len(rows) == at_most else 0
    return "\n".join(lines + ([f"... {more} more rows"] if more > 0 else []))


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames (path, frame_idx, h, w, c, pixels), those of a clip together and in order."""
    frames.repartition("path").sortWithinPartitions("path", "frame_idx").write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str, at_most: int = 10_000) -> None:
    """A small result as one JSON file; larger ones are refused."""
    rows = [r.asDict(recursive=True) for r in df.limit(at_most + 1).collect()]
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} rows: write a table")
    Path(path).write_text(json.dumps(rows, default=str, indent=1))


def write_template(values: dict, path: str) -> None:
    """Nested settings as YAML text."""

    def lines(node: dict, depth: int = 0) -> list[str]:
        out = []
        for key, value in node.items():
            if isinstance(value, dict):
                out += ["  " * depth + f"{key}:", *lines(value, depth + 1)]
            elif isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
                out.append("  " * depth + f"{key}:")
                for x in value:
                    first, *rest = lines(x, depth + 2)
                    out += ["  " * (depth + 1) + "- " + first.lstrip(), *rest]
            else:
                out.append("  " * depth + f"{key}: {json.dumps(value)}")
        return out

    Path(path).write_text("\n".join(lines(values)) + "\n")

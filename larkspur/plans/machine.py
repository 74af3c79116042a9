"""The curate, train, preview machine, and capacity advice."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

STEPS = ("curated", "trained", "previewed")


def run_machine(state_file: str, steps: dict[str, Callable[[], object]]) -> str:
    """Run the steps (keys of ``STEPS``) that a state file hasn't seen; it is replaced atomically after each."""
    path = Path(state_file)
    stage = json.loads(path.read_text()).get("stage") if path.exists() else None
    start = STEPS.index(stage) + 1 if stage in STEPS else 0
    for name in STEPS[start:]:
        if name in steps:
            steps[name]()
        stage = name
        held = path.with_suffix(".tmp")
        held.write_text(json.dumps({"stage": stage}))
        os.replace(held, path)
    return stage


def run_all(curate: Callable[[], dict], train: Callable[[dict], object], validate: Callable[[object], object]) -> dict:
    """Curate, train and validate; nothing kept is a RuntimeError."""
    made = curate()
    if not made["kept"]:
        raise RuntimeError("curation kept nothing, so there is nothing to train on")
    model = train(made)
    return {"curation": made, "model": model, "validation": validate(model)}


def advise(cores: int | None = None, ram_gib: float | None = None, transcribing: bool = False) -> dict:
    """Workers and memory for this machine, with the session settings that follow."""
    cores = cores or os.cpu_count() or 1
    if ram_gib is None:
        try:
            ram_gib = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
        except (ValueError, OSError):
            ram_gib = 0
    if ram_gib:
        workers = max(1, min(cores, int(ram_gib // 1), 8))
        each = round(ram_gib / workers * 0.75, 2)
    else:
        workers, each = min(cores, 4), 1.0
    warnings = ["memory is short for transcription"] if transcribing and ram_gib and ram_gib < workers * 0.5 else []
    return {"workers": workers, "ram_per_worker_gib": each, "warnings": warnings, "master": f"local[{workers}]", "spark.driver.memory": f"{max(1, int(each * workers))}g"}

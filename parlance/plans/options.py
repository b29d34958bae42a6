"""Options of a run and their command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """Defaults of every stage; ``None`` leaves the choice to the stage."""

    language: str | None = None
    split_on_turns: bool = True
    least_fragment_ms: int = 200
    split_threshold_ms: int = 300
    snap_window_ms: int = 0
    snap_below: float = 0.7
    filler_tie_ms: int = 0
    deadband_ms: int = 0
    proofread: bool = False
    proofread_context: int = 3
    structure: bool = True
    redact_topics: tuple[str, ...] | None = None
    redact_policy: str = "placeholder"
    summary: bool = True
    least_silence_ms: int | None = None
    names: tuple[str, ...] | None = None
    dump: str | None = None
    resume: bool = False
    user_context: str | None = None
    model: str | None = None
    proofread_model: str | None = None
    identify_model: str | None = None
    structure_model: str | None = None
    redact_model: str | None = None
    summary_model: str | None = None

    def model_of(self, stage: str) -> str | None:
        """The stage's own model, else the run's; null for stages without one."""
        own = {"proofread": self.proofread_model, "identify": self.identify_model, "structure": self.structure_model, "safe_speech": self.redact_model, "summary": self.summary_model}
        return own[stage] or self.model if stage in own else None

    def changed(self) -> list[str]:
        """Flags of what differs from the defaults; switches that are off read ``--no-x``."""
        out = []
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None or value == f.default or f.name in ("user_context", "redact_topics", "resume"):  # those have cells of their own, or change nothing
                continue
            flag = f.name.replace("_", "-")
            out.append((f"--{flag}" if value else f"--no-{flag}") if isinstance(value, bool) else f"--{flag} {','.join(value) if isinstance(value, tuple) else value}")
        return out


def names(text: str | None) -> tuple[str, ...] | None:
    """Comma list; none given is not an empty list."""
    return None if text is None else tuple(x.strip() for x in text.split(",") if x.strip())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parlance", description="Conversation analytics over many recordings.")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            out.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        elif "tuple" in str(f.type):
            out.add_argument(flag, type=names, default=f.default)
        else:
            kind = int if "int" in str(f.type) else float if "float" in str(f.type) else str
            out.add_argument(flag, type=kind, default=f.default)
    return out


def from_args(args: list[str] | None = None) -> Options:
    return Options(**vars(parser().parse_args(args)))

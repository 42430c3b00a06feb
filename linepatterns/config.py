"""Options of a mining run."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from linepatterns.functions.regex import java_pattern, parse_template

log = logging.getLogger("linepatterns")


@dataclass(frozen=True)
class MinerConfig:
    """``support``: lines a word or pattern needs (absolute); ``rsupport``: the same as a percentage of all lines, if support is None.

    ``max_words``: words of a line after so many are dropped; None keeps all, 512 is what the C reference does.
    ``max_line_bytes``: longer lines are cut into several; None keeps them whole, 10,239 is what the C reference does.
    """

    support: int | None = None
    rsupport: float | None = None
    separator: str = "[ ]+"
    byteoffset: int = 0
    lfilter: str | None = None
    template: str | None = None
    wfilter: str | None = None
    wsearch: str | None = None
    wreplace: str | None = None
    wsize: int = 0
    csize: int = 0
    aggrsup: bool = False
    wweight: float = 0.0
    weightf: int = 1
    outputmode: int = 0
    detailtoken: bool = False
    outliers_use_rewrite: bool = False
    max_words: int | None = None
    max_line_bytes: int | None = None
    broadcast_words: int = 1_000_000
    broadcast_bytes: int = 32 << 20

    def __post_init__(self):
        def need(ok: bool, what: str):
            if not ok:
                raise ValueError(what)

        need(self.support is not None or self.rsupport is not None, "support or rsupport is needed")
        need(self.rsupport is None or 0 <= self.rsupport <= 100, "rsupport is a percentage")
        need(self.byteoffset >= 0, "byteoffset can't be negative")
        need(self.wsize >= 0 and self.csize >= 0, "sketch sizes can't be negative")
        need(not (self.aggrsup and self.csize), "aggrsup and csize exclude each other")
        need(0 <= self.wweight <= 1, "wweight lies between 0 and 1")
        need(self.weightf in (1, 2), "weightf is 1 or 2")
        need(self.outputmode in (0, 1), "outputmode is 0 or 1")
        need(self.max_words is None or self.max_words > 0, "max_words must be positive")
        need(self.max_line_bytes is None or self.max_line_bytes > 0, "max_line_bytes must be positive")
        need(self.wfilter is None or (self.wsearch is not None and self.wreplace is not None), "wfilter needs wsearch and wreplace")
        for name in ("separator", "lfilter", "wfilter", "wsearch"):
            if (value := getattr(self, name)) is not None:
                java_pattern(value)
        need(not re.match(java_pattern(self.separator, python=True), ""), "the separator matches the empty string")
        if self.template is not None:
            parse_template(self.template)
            if self.lfilter is None:
                log.warning("template has no effect without lfilter")

    @property
    def rewrites(self) -> bool:
        return self.wfilter is not None

    @staticmethod
    def parse_support(value: str) -> dict:
        """``N`` or ``N%``."""
        return {"rsupport": float(value[:-1])} if value.endswith("%") else {"support": abs(int(value))}

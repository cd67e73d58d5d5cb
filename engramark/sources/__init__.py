"""Part of engramark."""

from engramark.sources import literals as _literals  # noqa: F401 - registers its workloads

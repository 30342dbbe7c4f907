"""Composed workflows (flagship sensitivity summary, curation chain, feature preparation) and the
registered analogue queries over the driver's tables."""

"""The registered queries: operators applied to the driver's tables, each with its SQL."""

from granary.plans import aggregates, catalogue, control, exports, files, history, snapshots, trees  # noqa: F401

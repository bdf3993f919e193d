"""The orchestrator: validate, window, compute, select, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.features import feature_names
from tidemark.operators.select import select_features
from tidemark.operators.validate import validate
from tidemark.plans.engine import attach_all
from tidemark.plans.shared import written
from tidemark.spec import FeatureConfig, SeriesSpec

#: Helper column: whether a full window ends at the row.
FULL = "__full_window"


# fixed values: names and defaults of the public signature
def generate_features(
    df: DataFrame,
    *,
    enable_rocket: bool = True,
    enable_catch22: bool = True,
    enable_signatures: bool = True,
    enable_wavelets: bool = True,
    enable_tsfresh: bool = True,
    rocket_n_kernels: int = 250,
    tsfresh_mode: str = "comprehensive",
    signature_depth: int = 3,
    wavelet_types: list[str] | None = None,
    window_sizes: list[int] | None = None,
    multi_window: bool = False,
    compute_channels: list[str] | None = None,
    signature_channels: list[str] | None = None,
    feature_selection: str | None = None,
    correlation_threshold: float = 0.95,
    output_dtype: str = "float32",
    symbol_col: str = "symbol",
    date_col: str = "date",
    close_col: str = "close",
    volume_col: str = "volume",
    tiebreak_cols: list[str] | None = None,
    packed: str | None = None,
    safe_names: bool = False,
) -> DataFrame:
    """``df`` with the features of the window that ends at each row; rows and columns of ``df`` stay as they are.

    As customary, only the first of ``window_sizes`` is used unless ``multi_window`` is set; then columns of each
    length get the prefix ``w{size}_``, and all lengths are computed in one pass.  ``packed`` names one array column in
    place of many columns, which is much faster to write; ``feature_names`` gives its order.  ``safe_names`` writes
    ``p`` for dots in names.  With ``feature_selection="auto"`` the features are written once to the shared folder, and
    the result reads the chosen ones from there.
    """
    spec = SeriesSpec(symbol_col, date_col, tuple(compute_channels or [close_col]), tuple(signature_channels or [close_col, volume_col]) if enable_signatures else (), tuple(tiebreak_cols or ()))
    switches = {"kernels": enable_rocket, "canonical": enable_catch22, "wavelets": enable_wavelets, "statistics": enable_tsfresh, "signatures": enable_signatures}
    sizes = list(dict.fromkeys(window_sizes or [20]))
    engines = tuple(e for e, on in switches.items() if on)
    configs = {}
    for size in sizes if multi_window else sizes[:1]:
        prefix = f"w{size}_" if multi_window else ""
        configs[prefix] = FeatureConfig(size, engines, rocket_n_kernels, wide=tsfresh_mode == "comprehensive", depth=signature_depth, wavelets=tuple(wavelet_types or ("haar", "db4")))
    names = {prefix: list(feature_names(cfg, spec.channels, spec.signature_channels)) for prefix, cfg in configs.items()}
    checked = validate(df, spec)
    if packed:
        return attach_all(checked, spec, configs, packed=packed)
    if feature_selection == "auto":
        out = written(attach_all(checked, spec, configs, full=FULL))
        for prefix, own in names.items():
            full = out.where(F.col(prefix + FULL)).select(*[F.col(f"`{prefix}{n}`").alias(n) for n in own])
            names[prefix] = select_features(full, own, correlation=correlation_threshold)
    else:
        out = attach_all(checked, spec, configs)
    label = lambda n: n.replace(".", "p") if safe_names else n
    kind = "float" if output_dtype == "float32" else "double"
    every = {prefix + n: label(prefix + n) for prefix, own in names.items() for n in own}
    kept = [c for c in checked.columns if c not in set(every) | set(every.values())]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{n}`").cast(kind).alias(new) for n, new in every.items()])

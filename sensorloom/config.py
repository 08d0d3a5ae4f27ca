"""Session settings and the parameters of detection, sorting and curation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


def session(app: str = "sensorloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Parameters:
    """Times in ms, distances in micrometres; frames follow from ``khz``."""

    khz: float = 20.0
    stringent: float = 0.275
    loose: float = 0.1
    half_window: float = 0.5
    front_buffer: float = 2.0
    noise_window: float = 50.0
    inner_radius: float = 50.0
    outer_radius: float = 100.0
    min_amp_dist_p: float = 0.1
    min_root_events: int = 10
    min_loose: int = 4
    min_inner_loose: int = 3
    min_loose_share: float = 1 / 3
    max_latency_diff: float = 2.5
    max_amp_diff: float = 0.45
    clip_latency_diff: float = 5.0
    clip_amp_diff: float = 0.9
    max_root_amp_z: float = 2.5
    min_elec_prob: float = 0.03
    relocate_latency: float = -2.0
    relocate_amp: float = 0.8
    overlap: float = 0.2
    refractory: float = 1.5
    match_delta: float = 0.4
    match_distance: float = 100.0
    fr_min: float = 0.05
    isi_max: float = 1.0
    snr_min: float = 5.0
    spikes_min_first: int = 30
    spikes_min_second: int = 50
    std_norm_max: float = 0.3
    pos_peak: float = 2.0

    def frames(self, ms: float) -> int:
        return round(ms * self.khz)

    def with_(self, **changes) -> Parameters:
        return replace(self, **changes)


#: Values of published runs.
DENSE_PROBE = Parameters(khz=30.0, stringent=0.175, loose=0.075)
PLANAR_ARRAY = Parameters(min_amp_dist_p=-1.0, max_amp_diff=0.65, max_latency_diff=3.5, clip_latency_diff=7.0, clip_amp_diff=1.3)

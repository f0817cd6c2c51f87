"""Label vocabularies as plain values and as small dimension frames.

Everything under "fixed values" is data that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families in index order, orders by data set and family, limits.
FAMILIES = ["AM", "FM", "FSK", "PSK", "QAM", "PAM"]
SYNTHETIC = {
    "FM": ["NBFM_25", "NBFM_50", "WBFM", "NFM_CTCSS", "NFM_DCS"],
    "AM": ["AM_AIR_25K", "AM_AIR_833"],
    "PSK": ["BPSK", "QPSK"],
    "FSK": ["DMR", "M17", "YSF", "NXDN", "dPMR", "P25", "BELL202", "G3RUH", "GMSK_BT05", "GMSK_BT03"],
}
RADIOML = {
    "AM": ["AM-DSB", "AM-SSB"],
    "FM": ["WBFM"],
    "PSK": ["BPSK", "QPSK", "8PSK"],
    "QAM": ["16QAM", "64QAM", "QAM16", "QAM64"],
    "FSK": ["CPFSK", "GFSK"],
    "PAM": ["PAM4"],
}
HISARMOD = {
    "FSK": ["2FSK", "4FSK", "8FSK", "16FSK", "32FSK", "64FSK", "128FSK", "256FSK", "GMSK", "MSK"],
    "PSK": ["BPSK", "QPSK", "8PSK", "16PSK", "32PSK", "OQPSK"],
    "QAM": ["16QAM", "32QAM", "64QAM", "128QAM", "256QAM"],
    "AM": ["AM-DSB", "AM-SSB", "OOK", "4ASK"],
    "FM": ["FM"],
}
#: Class order of the second data set, which substring matching of keys goes by.
HISARMOD_ORDER = [
    "2FSK", "4FSK", "8FSK", "16FSK", "32FSK", "64FSK", "128FSK", "256FSK", "BPSK", "QPSK", "8PSK", "16PSK", "32PSK",
    "16QAM", "32QAM", "64QAM", "128QAM", "256QAM", "AM-DSB", "AM-SSB", "FM", "GMSK", "OQPSK", "MSK", "OOK", "4ASK",
]
CSPB = {"PSK": ["BPSK", "QPSK", "8PSK", "DQPSK"], "QAM": ["16QAM", "64QAM", "256QAM"], "FSK": ["MSK"]}
#: A family is looked up in this order of data sets; two names stand beside them.
FAMILY_SOURCES = [("synthetic", SYNTHETIC), ("radioml", RADIOML), ("hisarmod", HISARMOD), ("cspb", CSPB), ("extra", {"FM": ["FM", "NBFM"]})]
SKIP_FOR_FAMILY = ["WBFM", "BPSK", "QPSK"]
GMSK_LIKE = ["GMSK", "GMSK_BT05", "GMSK_BT03", "MSK", "NXDN", "dPMR"]
AIR = ["AM-DSB", "AM_AIR_25K", "AM_AIR_833"]
ORDER_ALIASES = (
    {x: GMSK_LIKE for x in ("GMSK", "GMSK_BT05", "GMSK_BT03", "MSK")}
    | {x: AIR for x in AIR}
    | {x: ["CPFSK", "GFSK"] for x in ("CPFSK", "GFSK")}
    | {x: ["NXDN", "dPMR"] for x in ("NXDN", "dPMR")}
    | {"AM-SSB": ["AM-SSB", "AM-DSB", "WBFM", "NBFM_25", "NBFM_50", "NFM_CTCSS", "NFM_DCS"]}
)
SSB_ORDERS = ["AM-SSB", "AM-DSB-SC", "USB", "LSB"]
SSB_FAMILIES = ["AM", "FM", "QAM"]
HARD_FAIL = 0.40
THRESHOLD = 0.70
CHUNK = 1024
MAX_FILE = 50 * 1024 * 1024
#: Modes: name, canonical name, family, order, generation, protocol only, kind of note (see NOTES).
MODES = [
    ("NBFM", "NBFM", "FM", "NBFM_25", "gr3_builtin", False, ""),
    ("WBFM", "WBFM", "FM", "WBFM", "gr3_builtin", False, ""),
    ("AM", "AM", "AM", "AM-DSB", "gr3_builtin", False, ""),
    ("SSB", "SSB", "AM", "AM-SSB", "numpy", False, ""),
    ("BPSK", "BPSK", "PSK", "BPSK", "gr3_builtin", False, ""),
    ("QPSK", "QPSK", "PSK", "QPSK", "gr3_builtin", False, ""),
    ("8PSK", "8PSK", "PSK", "8PSK", "gr3_builtin", False, ""),
    ("GMSK", "GMSK", "FSK", "GMSK", "synthetic", False, ""),
    ("2FSK", "2FSK", "FSK", "CPFSK", "numpy", False, ""),
    ("4FSK", "4FSK", "FSK", "CPFSK", "numpy", False, ""),
    ("8FSK", "8FSK", "FSK", "CPFSK", "numpy", False, ""),
    ("DMR", "DMR", "FSK", "DMR", "synthetic", True, "protocol"),
    ("M17", "M17", "FSK", "M17", "synthetic", True, "protocol"),
    ("YSF", "YSF", "FSK", "YSF", "synthetic", True, "protocol"),
    ("D-Star", "D-Star", "FSK", "GMSK_BT05", "synthetic", True, ""),
    ("DSTAR", "D-Star", "FSK", "GMSK_BT05", "synthetic", True, ""),
    ("NXDN", "NXDN", "FSK", "NXDN", "synthetic", True, "protocol"),
    ("dPMR", "dPMR", "FSK", "dPMR", "synthetic", True, "protocol"),
    ("P25", "P25", "FSK", "P25", "synthetic", True, ""),
    ("NFM_CTCSS", "NFM_CTCSS", "FM", "NFM_CTCSS", "synthetic", False, ""),
    ("NFM_DCS", "NFM_DCS", "FM", "NFM_DCS", "synthetic", False, ""),
    ("BELL202", "BELL202", "FSK", "BELL202", "synthetic", False, ""),
    ("G3RUH", "G3RUH", "FSK", "G3RUH", "synthetic", False, ""),
    ("VARA FM", "VARA FM", "FSK", "G3RUH", "synthetic", False, ""),
    ("SOQPSK", "SOQPSK", "PSK", "QPSK", "numpy", False, ""),
    ("FreeDV", "FreeDV", "FSK", "GMSK", "numpy", False, "approximation"),
    ("IL2P", "IL2P", "FSK", "BELL202", "synthetic", False, "protocol"),
    ("FX.25", "FX.25", "FSK", "BELL202", "synthetic", False, "protocol"),
    ("AX.25", "AX.25", "FSK", "BELL202", "synthetic", False, "protocol"),
    ("APRS", "APRS", "FSK", "BELL202", "synthetic", False, ""),
    ("LDPC", "LDPC", "--", "--", "skip", False, ""),
    ("DSSS", "DSSS", "--", "--", "skip", False, ""),
    ("GDSS", "GDSS", "--", "--", "skip", False, ""),
    ("sleipnir_8qpsk", "sleipnir_8qpsk", "custom", "sleipnir_8qpsk", "plugin", False, ""),
    ("8xQPSK", "sleipnir_8qpsk", "custom", "sleipnir_8qpsk", "plugin", False, ""),
]
INCLUDES = ["gr-qradiolink", "gr-packet-protocols", "gr-sleipnir"]
FRAMEWORK = ["gnuradio", "gnuradio4", "gnuradio3"]
EXCLUDES = [*FRAMEWORK, "gr-linux-crypto", "gr-linux-crypto-backup", "gr-nacl", "gr-openssl", "gr-opus", "GR-K-GDSS", "app_rpt", "gr-ident", "gr-rake"]
TRUTH_ALIASES = {"bpsk": "BPSK", "qpsk": "QPSK", "8psk": "8PSK", "dqpsk": "DQPSK", "16qam": "16QAM", "64qam": "64QAM", "256qam": "256QAM", "msk": "MSK"}
#: 4FSK protocols: baud, inner and outer deviation (Hz), pulse.
FSK4 = {
    "DMR": (4800.0, 648.0, 1944.0, "rc", 0.2, 8),
    "M17": (4800.0, 800.0, 2400.0, "rrc", 0.5, 8),
    "YSF": (4800.0, 800.0, 2400.0, "gauss", 0.5, 4),
    "NXDN": (2400.0, 350.0, 1050.0, "rc", 0.2, 8),
    "dPMR": (2400.0, 350.0, 1050.0, "rc", 0.2, 8),
    "P25": (4800.0, 600.0, 1800.0, "rc", 0.2, 8),
}
#: Most occupied bandwidth (Hz) of a clean reference.
BANDWIDTH = {
    "NBFM_25": 7000.0, "NBFM_50": 13000.0, "AM_AIR_25K": 8000.0, "AM_AIR_833": 6500.0, "WBFM": 200000.0, "BPSK": 12000.0, "QPSK": 12000.0,
    "DMR": 14000.0, "M17": 14000.0, "YSF": 14000.0, "NXDN": 8000.0, "dPMR": 8000.0, "NFM_CTCSS": 7200.0, "NFM_DCS": 7200.0, "P25": 14000.0,
    "BELL202": 14000.0, "G3RUH": 14000.0, "GMSK_BT05": 14000.0, "GMSK_BT03": 14000.0,
}
SNR_LEVELS = list(range(-20, 32, 2))
SCAN_SNR = {"FM": 20.0, "FSK": 15.0, "PSK": 15.0, "AM": 20.0, "QAM": 20.0}
CARRIERS = [-4550.0, -3250.0, -1950.0, -650.0, 650.0, 1950.0, 3250.0, 4550.0]
# End of the fixed values.

#: What is said of a mode by its kind.
NOTES = {"": "", "protocol": "only the waveform is judged, the protocol above it is not", "approximation": "Approximation: a similar waveform is judged in its place"}

ORDERS = sorted(
    {x for _, m in FAMILY_SOURCES[:4] for v in m.values() for x in v} | {"NBFM"}
)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def alias_frame(spark: SparkSession) -> DataFrame:
    """(expected, accepted): what counts as the expected order, itself aside."""
    return frame(spark, [(k, a) for k, v in sorted(ORDER_ALIASES.items()) for a in v], "expected string, accepted string")


def family_frame(spark: SparkSession) -> DataFrame:
    """(order_name, family, prio, source) over all data sets; the least prio holds."""
    return frame(spark, [(o, f, p, s) for p, (s, m) in enumerate(FAMILY_SOURCES) for f, v in m.items() for o in v], "order_name string, family string, prio int, source string")


def mode_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, [(i, *m[:-1], NOTES[m[-1]]) for i, m in enumerate(MODES)], "ord int, mode string, canonical string, family string, order_name string, method string, protocol_only boolean, note string")


def literal_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])

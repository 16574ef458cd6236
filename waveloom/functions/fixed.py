"""Tables, names and limits that results depend on."""

# Frequency bands in Hz, half open [lo, hi).
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45)}

# Spelling of channel names after clean-up (upper-case key -> name).
CHANNEL_ALIASES = {
    "FP1": "Fp1", "FP2": "Fp2", "FPZ": "Fpz", "F7": "F7", "F3": "F3", "FZ": "Fz", "F4": "F4", "F8": "F8",
    "T3": "T3", "T4": "T4", "T5": "T5", "T6": "T6", "C3": "C3", "CZ": "Cz", "C4": "C4", "P3": "P3",
    "PZ": "Pz", "P4": "P4", "O1": "O1", "O2": "O2", "OZ": "Oz", "A1": "A1", "A2": "A2", "M1": "A1",
    "M2": "A2", "EKG": "EKG", "ECG": "EKG", "PHOTIC": "Photic",
}

# Class spellings per data set: (data set, class, id, accepted spellings).
LABEL_ALIASES = [
    ("aheap", "HC", 0, ["C", "HC", "CN", "CONTROL", "CONTROLS", "HEALTHY", "NORMAL", "0"]),
    ("aheap", "AD", 1, ["A", "AD", "ALZHEIMER", "ALZHEIMERS", "ALZHEIMER'S DISEASE", "1"]),
    ("aheap", "FTD", 2, ["F", "FTD", "FRONTOTEMPORAL DEMENTIA", "FRONTO TEMPORAL DEMENTIA", "2"]),
    ("caueeg", "Healthy", 0, ["HEALTHY", "HC", "CN", "CONTROL", "NORMAL", "0"]),
    ("caueeg", "Dementia", 1, ["DEMENTIA", "ALZHEIMER", "AD", "1"]),
    ("caueeg", "MCI", 2, ["MCI", "MILD COGNITIVE IMPAIRMENT", "2"]),
]

# Group code of a participants table -> class id, per task; groups not listed are dropped.
GROUP_CODES = {
    "all3": {"C": 0, "A": 1, "F": 2},
    "all2": {"C": 0, "A": 1, "F": 1},
    "adhc": {"C": 0, "A": 1},
    "ftdhc": {"C": 0, "F": 1},
    "adftd": {"A": 1, "F": 0},
}

# Symptom words that decide the class, first rule that matches wins.
SYMPTOM_RULES = [
    ("Healthy", ["normal", "smi"]),
    ("Dementia", ["dementia", "ad", "load"]),
    ("MCI", ["mci", "mci_amnestic", "mci_vascular"]),
]

# Upper limits for window quality, strict.
QC_LIMITS = [
    ("max_abs_uv", 200.0),
    ("max_ptp_uv", 300.0),
    ("global_std_uv", 80.0),
    ("flat_channel_frac", 0.3),
    ("high_kurtosis_frac", 0.5),
]
FLAT_STD_UV = 0.05
KURTOSIS_LIMIT = 8.0

# Scalp regions and their channels.
REGIONS = {
    "frontal": ["Fp1", "Fp2", "F3", "F4", "F7", "F8", "Fz"],
    "central": ["C3", "C4", "Cz"],
    "parietal": ["P3", "P4", "Pz"],
    "occipital": ["O1", "O2"],
    "temporal": ["T3", "T4", "T5", "T6"],
}

# Bipolar channel pairs (first minus second).
BIPOLAR_PAIRS = [
    ("F7", "F3"), ("F3", "Fz"), ("F4", "Fz"), ("F8", "F4"), ("F3", "C3"), ("Fz", "Cz"), ("F4", "C4"),
    ("C3", "T3"), ("C3", "Cz"), ("C4", "Cz"), ("C4", "T4"), ("T3", "T5"), ("C3", "P3"), ("Cz", "Pz"),
    ("C4", "P4"), ("T4", "T6"), ("P3", "Pz"), ("P4", "Pz"), ("P4", "O2"), ("P3", "O1"), ("T6", "O2"),
    ("T5", "O1"), ("O1", "O2"),
]

# Daubechies-4 scaling filter (eight taps, published coefficients).
DB4_LOWPASS = [
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.027983769416983849, 0.63088076792959036, 0.71484657055254153, 0.23037781330885523,
]

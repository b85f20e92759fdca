"""Names, patterns and texts that must be exactly these for results to agree."""

# Column names of a raw assay export, kept when present.
META_COLUMNS = [
    "Molecule ChEMBL ID",
    "Smiles",
    "Standard Type",
    "Standard Relation",
    "Standard Value",
    "Standard Units",
    "Target ChEMBL ID",
]

# Descriptor blocks: core, connectivity, surface areas, and the molecular quantum numbers.
CORE_COLUMNS = [
    "SlogP", "SMR", "LabuteASA", "TPSA", "AMW", "ExactMW",
    "NumLipinskiHBA", "NumLipinskiHBD", "NumRotatableBonds", "FractionCSP3", "HallKierAlpha",
]
CHI_COLUMNS = ["Chi0v", "Chi1n", "Chi1v", "Chi2n", "Chi2v", "Chi3n", "Chi3v", "Chi4n", "Chi4v"]
VSA_BLOCKS = {"peoe_VSA": 14, "slogp_VSA": 12, "smr_VSA": 10}
MQN_BLOCK = {"MQN": 42}


def block_columns(blocks: dict[str, int]) -> list[str]:
    """Numbered column names of vector blocks: ``{"a": 2}`` gives ``["a1", "a2"]``."""
    return [f"{prefix}{i}" for prefix, size in blocks.items() for i in range(1, size + 1)]


VSA_COLUMNS = block_columns(VSA_BLOCKS)
MQN_COLUMNS = block_columns(MQN_BLOCK)
DESCRIPTOR_COLUMNS = CORE_COLUMNS + CHI_COLUMNS + VSA_COLUMNS + MQN_COLUMNS

# Column names that never become model features.
NOT_FEATURES = [
    "Standard Value", "Molecule ChEMBL ID", "Smiles", "canonical_smiles",
    "Standard Type", "Standard Relation", "Standard Units", "Target ChEMBL ID", "activo",
    "PAINS_flag", "PAINS_terms", "Chelator_flag", "Chelator_terms",
    "Lipinski_violations", "Veber_violations",
]

# Columns added by the screens, and read by the report.
SCREEN_COLUMNS = [
    "PAINS_flag", "PAINS_terms", "Chelator_flag", "Chelator_terms",
    "Lipinski_violations", "Veber_violations",
]

# Where to look for the structure text and for the row id, first hit wins.
STRUCTURE_CANDIDATES = ["Smiles", "smiles", "SMILES", "canonical_smiles", "CanSmiles"]
STRUCTURE_FRAGMENT = "smile"
SCREEN_STRUCTURE_CANDIDATES = ["canonical_smiles", "Smiles", "SMILES", "smiles"]
ID_CANDIDATES = ["Molecule ChEMBL ID", "canonical_smiles", "Smiles"]

# Substructure (SMARTS) patterns of metal chelators; they need a chemistry matcher, see match_terms_with.
CHELATOR_PATTERNS = {
    "catechol_o_dihydroxybenzene": "c1c(O)cccc1O",
    "vicinal_diol": "[CX4](O)[CX4](O)",
    "hydroxamate": "[CX3](=O)N[OX2H,OX1-]",
    "dithiocarbamate": "[NX3][CX3](=S)[SX2]",
    "thiol": "[SX2H]",
    "8_hydroxyquinoline": "Oc1cccc2ncccc12",
}

# Texts read as missing in delimited files (the pandas defaults).
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts that count as true in flag columns.
TRUE_TEXTS = ["1", "true", "yes", "si", "sí", "y"]

# Report texts.
ACTIVE, INACTIVE = "Activo", "Inactivo"
NO_ALERTS = "Sin alertas"
ALERT_NO, ALERT_YES = "No", "Sí"
TERM_YES = "si"
DISCARDED = "❌ Descartado"
REVIEW = "⚠️ Revisión (Riesgo)"
SELECTED = "✅ Seleccionado"
NOT_SELECTED = "No seleccionado"
REPORT_HEADERS = [
    "ID Molécula (ChEMBL/SMILES)",
    "Probabilidad (Score)",
    "Predicción Clase",
    "Alerta PAINS",
    "Alerta Quelante",
    "Decisión Final",
]

# Search spaces: the short search and the extended one.
FOREST_SPACE = {
    "n_estimators": [400, 600, 800, 1200, 1600],
    "max_depth": [None, 10, 20, 30],
    "min_samples_leaf": [1, 2, 3],
}
BOOSTED_SPACE = {
    "n_estimators": [400, 800, 1200],
    "max_depth": [4, 6, 8],
    "learning_rate": [0.05, 0.1, 0.2],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
}
FOREST_SPACE_EXTENDED = {
    "n_estimators": [300, 500, 800, 1200, 1600, 1800, 2000, 2200],
    "max_depth": [None, 10, 20, 30, 40, 50],
    "min_samples_leaf": [1, 2, 3, 4, 5, 6],
    "max_features": ["sqrt", "log2", None],
}
BOOSTED_SPACE_EXTENDED = {
    "n_estimators": [400, 800, 1200, 1600, 1800, 2000],
    "max_depth": [4, 5, 6, 7, 8],
    "learning_rate": [0.05, 0.1, 0.15, 0.2],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
}

SEED = 1234
ROW_INDEX = "row_idx"

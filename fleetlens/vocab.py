"""Vocabulary and fixed values of the maintenance domain.

Fixed values (they must equal the reference application's for the same
results): the maintenance-type sets, priority labels and thresholds,
retired-asset states, fallback downtime hours, decay windows and factors.
"""

from __future__ import annotations

import datetime as _dt

# --- fixed values -----------------------------------------------------------
CORRECTIVE = ("correctiva", "correctivo", "emergency")
PREVENTIVE = ("preventiva", "preventivo", "mantenimiento")
PREVENTIVE_WITH_INSPECTION = ("preventiva", "preventivo", "mantenimiento", "inspeccion", "inspección")
PREDICTIVE = ("predictiva", "predictivo")

P1, P2, P3, P4 = "P1_critica", "P2_alta", "P3_media", "P4_baja"
PRIORITIES = (P1, P2, P3, P4)
URGENT = (P1, P2)
DEFAULT_THRESHOLDS = {"p1": 0.85, "p2": 0.75, "p3": 0.50}
LEGACY_THRESHOLDS = {"p1": 0.85, "p2": 0.65, "p3": 0.40}
HISTORIC_THRESHOLDS = {"p1": 0.80, "p2": 0.60, "p3": 0.30}

RETIRED_STATES = ("baja", "fuera_servicio", "inactivo")

SEVERITY_RANK = {"critica": 3, "crítica": 3, "media": 2, "leve": 1}
FALLBACK_HOURS_BY_RANK = {3: 24.0, 2: 8.0, 1: 4.0}
FALLBACK_HOURS_PREVENTIVE = 4.0
FALLBACK_HOURS_OTHER = 8.0

DECAY_WINDOW_DAYS = {"predictiva": 30, "correctiva": 30, "preventiva": 14}
DECAY_FACTOR = {"predictiva": 0.20, "correctiva": 0.30, "preventiva": 0.50}

HORIZONS = (7, 30, 90)
NO_HISTORY_SYSTEM = "sin_historial_ot"
UNCLASSIFIED = "sin_clasificar"
NO_MASTER = "SIN_MAESTRO"
# --- end of fixed values ----------------------------------------------------

# Reproducible "today" of the test fixtures (the driver data ends in 2001,
# the fleet views are cut at this date).
FIXTURE_AS_OF = _dt.date(2000, 1, 31)

"""Small reference and log rows for the core tests."""

from obslab.spec import BODY_MEASURES


def reference_rows(per_class=12):
    """Three classes whose measures are linear in class and number, so all rows differ."""
    return [
        {
            "species": name,
            "bill_length_mm": 35 + c * 10 + i / 10,
            "bill_depth_mm": 15 + c + i / 10,
            "flipper_length_mm": 180.0 + c * 20 + i,
            "body_mass_g": 3000.0 + c * 1000 + i * 10,
            "sex": "female" if i % 2 else "male",
            "island": "Biscoe",
            "row": c * 1000 + i,
        }
        for c, name in enumerate(BODY_MEASURES.labels) for i in range(per_class)
    ]


def log_row(**changes):
    return {
        "row": 1, "bill_length_mm": "50.5", "bill_depth_mm": "18", "flipper_length_mm": "201", "body_mass_g": "4300",
        "sex": "", "island": "Dream", "validated_species": "Chinstrap", **changes,
    }


REFERENCE_SCHEMA = (
    "species string, bill_length_mm double, bill_depth_mm double, flipper_length_mm double, body_mass_g double, "
    "sex string, island string, row bigint"
)
LOG_SCHEMA = (
    "row bigint, bill_length_mm string, bill_depth_mm string, flipper_length_mm string, body_mass_g string, "
    "sex string, island string, validated_species string"
)

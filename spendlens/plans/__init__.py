"""End-to-end plans: population pull, derivations, cohort grid, reports, query registry."""

"""Imbalance-aware feature ranking as DataFrame plans."""

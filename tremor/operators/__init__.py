"""Part of tremor."""

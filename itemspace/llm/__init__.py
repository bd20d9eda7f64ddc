"""Training-data operators (decontamination, dedup, scoring, packing, chat)."""

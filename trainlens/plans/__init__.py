"""Reusable physical layouts: blocked top-k scoring, distributed ordinals."""

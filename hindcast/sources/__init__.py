"""Readers, writers and the views that stand for a market, its futures curve and its dated event memory."""

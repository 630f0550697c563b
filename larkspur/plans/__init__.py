"""Logical plans: nodes, parser and analyzer."""

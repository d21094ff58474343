"""Readers, snapshot tables and exports."""

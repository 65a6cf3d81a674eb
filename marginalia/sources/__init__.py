"""Readers and writers for the stored forms of a knowledge base."""

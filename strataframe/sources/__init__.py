"""Readers that give the pixel relation and other inputs."""

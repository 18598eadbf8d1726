"""Part of tideline."""

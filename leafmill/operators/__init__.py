"""Operators over template trees and forms: DataFrame to DataFrame."""
